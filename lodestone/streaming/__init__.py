"""Structured Streaming: the file log as a change stream, and event-time aggregation."""
