"""Continuous ingestion and rate limits on Structured Streaming."""
