"""Structured Streaming jobs over the operation log."""
