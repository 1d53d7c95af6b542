"""Column functions: text, URLs, signals and rules. No Python runs per row."""
