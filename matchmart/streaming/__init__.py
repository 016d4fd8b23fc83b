"""Structured Streaming: resumable incremental ingest of landed files."""
