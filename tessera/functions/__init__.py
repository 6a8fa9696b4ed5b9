"""Catalogue building on Spark: functions."""
