"""Ingest by Structured Streaming."""
