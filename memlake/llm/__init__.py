"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage; the query registry adds
its queries only when it can be imported.
"""
