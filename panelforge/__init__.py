"""Equity sector analytics on Spark DataFrames."""
