"""Structured Streaming parts: limits, idempotent ingest, sequencing, counters, screening."""
