"""Operators for text corpora: extraction, filters, duplicates, contamination, packing.

Nothing else in the library imports this subpackage.
"""
