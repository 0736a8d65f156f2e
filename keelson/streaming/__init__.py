"""Watching for changes with Structured Streaming."""
