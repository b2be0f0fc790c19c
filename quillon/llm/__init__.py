"""Operators for building training corpora: filters, fingerprints, deduplication, scoring and mixing."""
