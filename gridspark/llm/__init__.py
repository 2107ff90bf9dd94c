"""Operators for preparing training text: scans, filters, near-duplicates, extraction, tokens and packing."""
