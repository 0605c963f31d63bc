"""Column functions: hashes, texts, vectors, canonical JSON."""
