"""Operators over training text, pages and vectors.  Nothing else in the library imports them."""
