"""Retrieval, grounding, scoring, evaluation and metering over DataFrames."""
