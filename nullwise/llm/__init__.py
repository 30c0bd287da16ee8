"""Operators of a training-data pipeline (mixing, extraction, quality, language,
token output, WARC, toxicity, near-duplicates, packing, embeddings).

Self-contained: nothing else in the library imports this package.
"""
