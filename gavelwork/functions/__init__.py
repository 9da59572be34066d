"""Column expressions. Every function takes columns and returns a column."""
