"""Column functions and result tables."""
