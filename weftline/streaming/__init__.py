"""Structured Streaming collection of batch results."""
