"""Operators for the data that language models learn from. Nothing outside this package imports it."""
