"""Provender: procurement analytics on Spark DataFrames."""
