"""Formulas, model series and the queries built from them."""
