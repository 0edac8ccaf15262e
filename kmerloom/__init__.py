"""Alignment-free sequence analytics on Spark DataFrames."""
