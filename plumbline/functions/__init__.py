"""Column functions: text, formatting, model outputs."""
