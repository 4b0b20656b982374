"""Column functions: JSON values, text forms, conditions."""
