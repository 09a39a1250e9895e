"""Operators for large text corpora: identification, mixing, search, privacy, duplicates, attribution."""
