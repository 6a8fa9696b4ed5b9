"""Catalogue building on Spark: operators."""
