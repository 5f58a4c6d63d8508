"""Operators for the data of language models. Nothing outside this package imports it."""
