"""Structured Streaming forms of the counting operators (an extension)."""
