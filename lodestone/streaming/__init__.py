"""Structured Streaming forms of the event log and the limits."""
