"""Structured Streaming forms of the activity operators."""
