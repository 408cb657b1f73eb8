"""Structured Streaming: usage, recency and session statistics."""
