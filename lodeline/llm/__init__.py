"""Operators for preparing training corpora: duplicates, quality, mixing, tokens, filters."""
