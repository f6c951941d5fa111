"""Operators for large text corpora: deduplication, tokens, search, licences, personal data, languages, URLs, web archives."""
