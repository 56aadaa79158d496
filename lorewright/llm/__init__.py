"""Operators of a training-data pipeline: search, scans, deduplication, language, mixing.

Nothing else in the library imports this subpackage.
"""
