"""Gridded space-time analytics on Spark DataFrames."""
