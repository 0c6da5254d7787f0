"""Column builders: keys, hashes, types."""
