"""Operators for preparing language-model training data; their queries are in ``queries``."""
