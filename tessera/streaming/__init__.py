"""Catalogue building on Spark: streaming."""
