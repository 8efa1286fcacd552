"""Structured Streaming entry points reusing the batch operators unchanged."""
