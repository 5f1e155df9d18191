"""Structured Streaming forms of the trace (STR1)."""
