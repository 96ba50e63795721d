"""Operators of a training-data pipeline: quality, duplicates, leaks, secrets, tokens, languages, pages and addresses."""
