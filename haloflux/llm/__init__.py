"""Operators for preparing training text: search, scoring, filtering and packing of documents.

Nothing else in the library imports this subpackage.
"""
