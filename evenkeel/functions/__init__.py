"""Column functions: portable hashing, the grid, random keys."""
