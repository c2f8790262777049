"""Operators of a training-data pipeline: cleaning, deduplication, scoring and tokenising of documents.

Nothing else in the library imports this subpackage.
"""
