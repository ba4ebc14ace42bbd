"""Readers, writers and the schemas of the input tables."""
