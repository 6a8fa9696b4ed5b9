"""Catalogue building on Spark: sources."""
