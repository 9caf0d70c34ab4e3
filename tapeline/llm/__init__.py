"""Operators for preparing training text and vectors. Nothing outside this package imports it."""
