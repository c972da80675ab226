"""Retrieval evaluation and agent-benchmark analytics on Spark DataFrames."""
