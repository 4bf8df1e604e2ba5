"""Structured Streaming forms of the monitoring jobs."""
