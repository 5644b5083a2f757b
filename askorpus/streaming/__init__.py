"""Structured Streaming versions of the thread and turn operations."""
