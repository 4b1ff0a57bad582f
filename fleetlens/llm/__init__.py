"""Operators for training-data pipelines: deduplication, filters, tokenisation, extraction, scoring."""
