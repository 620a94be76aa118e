"""Stateful forms of the session operators on Structured Streaming."""
