"""Scalar functions as Column expressions, and Arrow functions."""
