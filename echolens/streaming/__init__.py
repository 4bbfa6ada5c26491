"""Structured Streaming forms of the ingest, trend and bullet-comment jobs."""
