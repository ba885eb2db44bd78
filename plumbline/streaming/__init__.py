"""Checks over Structured Streaming."""
