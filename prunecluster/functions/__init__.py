"""Column expressions and scalar formulas."""
