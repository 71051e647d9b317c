"""Readers and writers of corpora, annotations and lexicons."""
