"""Structured Streaming twins of the ledger and ingest operators."""
