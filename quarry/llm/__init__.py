"""Operators for preparing training text: deduplication, sharding, tokenising, mixing, scoring, media."""
