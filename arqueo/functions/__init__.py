"""Column expressions: text to number, dates, aging, finance."""
