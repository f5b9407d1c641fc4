"""Structured Streaming forms of merging, live queries and framing."""
