"""Operators for preparing training data: language, licences, quality, tokens, near copies, media, PII, mixing."""
