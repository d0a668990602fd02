"""Lodestone: batch ranked retrieval and document processing on Spark DataFrames."""
