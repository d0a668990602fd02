"""Column expressions on texts and vectors."""
