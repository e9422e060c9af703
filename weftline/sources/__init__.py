"""Readers and writers of corpus formats."""
