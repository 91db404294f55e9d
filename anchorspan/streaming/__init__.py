"""Structured Streaming forms of the lift."""
