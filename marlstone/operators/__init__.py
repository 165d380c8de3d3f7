"""Relational operators: pairing, graphs, deduplication, alignment, scoring, records."""
