"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it can be removed as a
whole.
"""
