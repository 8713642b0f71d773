"""Readers and writers: collections, queries, judgments, priors, runs, the interchange format."""
