"""Skew-safe building blocks and the registered query plans."""
