"""Ingest with Structured Streaming."""
