"""Structured Streaming over the trace of pipeline events."""
