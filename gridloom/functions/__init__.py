"""Scalar functions over formulas and addresses."""
