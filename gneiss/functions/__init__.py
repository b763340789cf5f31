"""Scalar functions, all as column expressions."""
