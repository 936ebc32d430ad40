"""Electrophysiology analytics on Spark DataFrames."""
