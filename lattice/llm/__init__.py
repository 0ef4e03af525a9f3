"""Operators for building training corpora: search, formatting, extraction, joins, scoring, mixing, packing."""
