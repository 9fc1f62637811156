"""Operators for preparing language-model training data (importing this package imports none of them)."""
