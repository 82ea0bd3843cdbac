"""Column functions and checksums."""
