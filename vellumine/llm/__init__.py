"""Operators of a training-data pipeline over text collections.

Nothing else in the library imports this subpackage; it can be removed as a
whole.
"""
