"""Operators for building training corpora: deduplication, filtering, packing, formatting, sanitising."""
