"""Structured Streaming forms of the bounded-stream operators."""
