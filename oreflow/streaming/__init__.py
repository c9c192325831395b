"""Stateless operators on Structured Streaming."""
