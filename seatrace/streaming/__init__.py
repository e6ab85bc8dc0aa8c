"""Structured Streaming entry points (an extension: the batch plans don't need them)."""
