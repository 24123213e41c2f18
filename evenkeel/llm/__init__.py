"""Operators for preparing text corpora: deduplication, filtering, mixing and encoding.

Nothing outside this subpackage imports it.
"""
