"""Structured Streaming jobs over file streams."""
