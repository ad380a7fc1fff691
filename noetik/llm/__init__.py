"""Operators for large-scale text corpora; nothing else in the library imports them."""
