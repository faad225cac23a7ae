"""Column expressions and path globs."""
