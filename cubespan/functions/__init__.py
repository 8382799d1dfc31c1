"""Column expressions, numerical kernels and SQL functions."""
