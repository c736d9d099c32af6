"""Structured Streaming variants of the event analytics."""
