"""Noisy-text analytics on Spark DataFrames."""
