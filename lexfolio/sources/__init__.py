"""Readers, derived corpora and writers."""
