"""Scalar helpers as Spark columns."""
