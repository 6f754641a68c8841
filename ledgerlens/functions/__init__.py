"""Column functions: rounding, dates and statistics."""
