"""Column expressions: text, numbers, periods, agreement of values. No Python runs per row in any of them."""
