"""Deductive analytics on Spark DataFrames."""
