"""Column helpers and skew-safe ordered computations."""
