"""Scans, corpus assembly, sinks and the resume ledger."""
