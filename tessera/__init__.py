"""Catalogue building on Spark: jobs over tables of pages, candidates and observations."""
