"""Streaming jobs; each has a batch form of the same result."""
