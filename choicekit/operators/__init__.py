"""Operators on choice sets: design columns, checks, the likelihood kernel and what is built on it."""
