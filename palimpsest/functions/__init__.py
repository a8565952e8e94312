"""Column functions and plain-Python semantics."""
