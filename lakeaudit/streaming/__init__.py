"""Structured Streaming forms (rate buckets)."""
