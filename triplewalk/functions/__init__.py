"""Column expressions and weighing schemes."""
