"""Incremental work as streams: ledgers of fetch records, export progress, windows over events."""
