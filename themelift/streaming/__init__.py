"""Structured Streaming form of the matching plan."""
