"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Each module holds one operator, ``queries`` registers them.
"""
