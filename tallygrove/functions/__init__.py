"""Column functions: cleaning, parsing, tagging and extraction."""
