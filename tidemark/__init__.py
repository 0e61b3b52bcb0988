"""Incremental case and event analytics on Spark DataFrames."""
