"""Column functions: text, numbers, contracts."""
