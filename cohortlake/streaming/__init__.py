"""Structured Streaming forms of the log, change and session jobs."""
