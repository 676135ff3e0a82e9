"""Operators for language-model training text. Nothing outside this folder imports it."""
