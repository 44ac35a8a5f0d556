"""Operators for preparing training text: deduplication, filters, scans, archives and tokens."""
