"""Operators on the corpus tables."""
