"""Stateful processors and streaming jobs."""
