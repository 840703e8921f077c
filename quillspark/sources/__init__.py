"""Readers and writers of document, chunk and vector tables."""
