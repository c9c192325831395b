"""Column functions: missing values, text forms of numbers, seeded random numbers."""
