"""Structured Streaming forms of the ingest, scaling and log jobs."""
