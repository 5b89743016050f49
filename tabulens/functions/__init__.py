"""Column expressions: parsing, formatting and rounding."""
