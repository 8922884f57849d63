"""Structured Streaming versions of the windowed operators."""
