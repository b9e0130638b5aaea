"""Column expressions: text clean-up, skill names, scores."""
