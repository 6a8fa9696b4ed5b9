"""Catalogue building on Spark: plans."""
