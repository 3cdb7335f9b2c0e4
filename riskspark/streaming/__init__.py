"""Structured Streaming over the same operators that run in batch."""
