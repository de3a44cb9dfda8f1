"""Column functions: names, labels, text, payloads."""
