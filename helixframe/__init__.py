"""Genome-sequence analytics on Spark DataFrames."""
