"""Structured Streaming forms of the hourly tables."""
