"""Column expressions: reference lists, vectors and the time line."""
