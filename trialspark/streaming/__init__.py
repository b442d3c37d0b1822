"""Structured Streaming jobs over trial events."""
