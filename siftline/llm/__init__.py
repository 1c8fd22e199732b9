"""Operators for preparing large text corpora: quality, media, filters, dedup, privacy, mixing, tokens, language."""
