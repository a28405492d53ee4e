"""Column functions: deterministic hash order, guarded arithmetic, vectors."""
