"""Spark-first analytics and data-processing operators for listing-style tables."""
