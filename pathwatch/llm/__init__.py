"""Operators of a large training-data pipeline, each with its queries. Nothing else in the library imports this package."""
