"""Column expressions with the engine's NaN rules."""
