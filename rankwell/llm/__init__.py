"""Operators for preparing text corpora: token output, counts, extraction, filters, dedup, joins.

Nothing else in the library imports this package.
"""
