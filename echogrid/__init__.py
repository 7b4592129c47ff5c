"""Sparse acoustic-survey data on Spark: traces, bins and slices as DataFrames."""
