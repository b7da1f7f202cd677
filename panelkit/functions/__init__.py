"""Column expressions; each takes and returns columns."""
