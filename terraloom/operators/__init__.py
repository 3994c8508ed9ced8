"""Relational and vectorised operators."""
