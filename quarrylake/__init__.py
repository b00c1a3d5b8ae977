"""Retrieval, knowledge-graph and ingestion analytics on Spark DataFrames."""

__version__ = "0.1.0"
