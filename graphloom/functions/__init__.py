"""Column functions: text, vectors, ids, portable hashes."""
