"""Readers, parsers and writers of note folders, and the projections of the given tables."""
