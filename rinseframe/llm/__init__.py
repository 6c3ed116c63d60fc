"""Operators for preparing training data: languages, duplicates, quality, private data, tokens."""
