"""Incremental ingest of candidate records."""
