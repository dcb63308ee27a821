"""Column functions: patterns, URL rules, text decoding."""
