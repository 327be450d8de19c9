"""Incremental work: ingest with a gate and ledger, deduplication on ids, running counters, windows."""
