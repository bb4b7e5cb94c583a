"""Discrete-choice analytics on Spark DataFrames."""
