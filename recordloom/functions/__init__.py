"""Column functions: text, paths, versions, hashing."""
