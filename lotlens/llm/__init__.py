"""Operators of a training-data pipeline: text in, one result row per document, pair, record or query out."""
