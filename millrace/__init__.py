"""Millrace: commerce event, change-data and corpus analytics as plain PySpark transformations."""
