"""Maintained nested views and batch queries on PySpark DataFrames."""
