"""Readers and writers of vectors, layouts, labels and sweep results."""
