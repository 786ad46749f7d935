"""Structured Streaming queries over meter messages."""
