"""Column functions: predicates, vectors, paths and texture names."""
