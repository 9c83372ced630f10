"""Structured Streaming jobs; an extension over the batch operators."""
