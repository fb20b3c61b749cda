"""Column functions: pure rules, each written once."""
