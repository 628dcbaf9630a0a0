"""Structured Streaming input."""
