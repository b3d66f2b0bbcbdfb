"""Structured Streaming forms of the batch operators. Only native operators are used."""
