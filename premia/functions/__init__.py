"""Column expressions; all of them also work on a streaming DataFrame."""
