"""Incremental ingestion of landed ledger files with Structured Streaming."""
