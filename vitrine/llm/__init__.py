"""Operators for building training corpora: deduplication, filters, scoring, mixing, archives."""
