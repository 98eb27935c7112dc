"""Column expressions: clock, categories, strict aggregates, periodic bases."""
