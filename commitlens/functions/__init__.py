"""Column functions: scalars and predicates."""
