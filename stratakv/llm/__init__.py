"""Operators for building training corpora: quality, deduplication, tokens, licences, mixing, media."""
