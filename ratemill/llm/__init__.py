"""Operators on training texts: filters, duplicates, personal data, tokens and packing."""
