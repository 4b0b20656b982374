"""Continuous versions of the operators on Structured Streaming."""
