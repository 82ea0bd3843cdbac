"""Readers, writers, converters and generators of relations."""
