"""Column expressions of the data model."""
