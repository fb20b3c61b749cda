"""Driver queries."""
