"""Structured Streaming forms of the panel and one-step operators."""
