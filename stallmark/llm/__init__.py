"""Operators for training data: deduplication, scans, tokens, quality, search and mixing."""
