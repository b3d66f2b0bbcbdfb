"""Operators for preparing training text: tokens, quality, duplicates, secrets, archives."""
