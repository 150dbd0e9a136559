"""Structured Streaming forms of the ingest, search-miss and trial operators."""
