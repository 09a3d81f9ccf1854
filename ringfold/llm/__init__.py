"""Operators of a training-data pipeline: filters, search, codecs, mixing, scoring and deduplication.

Nothing outside this package imports it.
"""
