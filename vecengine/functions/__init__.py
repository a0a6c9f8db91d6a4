"""Column expressions over vectors."""
