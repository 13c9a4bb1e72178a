"""Readers and writers of listing records."""
