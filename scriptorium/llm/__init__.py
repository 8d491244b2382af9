"""Operators for preparing language-model training text; nothing else here imports this."""
