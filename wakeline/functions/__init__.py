"""Column expressions and vectorised kernels."""
