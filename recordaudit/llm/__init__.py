"""Operators that prepare training text: filters, deduplication, detection, formatting, extraction, mixing."""
