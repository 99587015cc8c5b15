"""Structured Streaming over run logs (live run status)."""
