"""Column -> Column functions: no Python workers on these paths."""
