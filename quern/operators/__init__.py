"""Relational operators on documents, indexes, runs and experiments."""
