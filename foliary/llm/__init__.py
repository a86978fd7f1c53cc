"""Operators for preparing training data from large document collections.

Nothing outside this subpackage imports it; it can be deleted without touching the rest.
"""
