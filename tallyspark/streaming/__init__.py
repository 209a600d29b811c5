"""Structured Streaming wrappers over the batch operators."""
