"""Column expressions: cleaning, tokens, features."""
