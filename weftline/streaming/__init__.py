"""Structured Streaming versions of stateless text operators and running counts."""
