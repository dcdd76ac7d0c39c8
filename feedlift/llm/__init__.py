"""Operators that prepare training text: cleaning, de-duplication, tokens and model-ready files."""
