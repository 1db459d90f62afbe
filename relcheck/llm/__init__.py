"""Operators for preparing training text: language ID, URL rules, deduplication, search, scoring, packing."""
