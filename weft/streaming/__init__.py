"""Incremental queries over edge streams."""
