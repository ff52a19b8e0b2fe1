"""Operators for preparing training data: dedup, scans, archives, media columns, language, tokens, mixing."""
