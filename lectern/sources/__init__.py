"""Readers, writers and run records."""
