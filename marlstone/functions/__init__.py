"""Scalar functions on text, code and names."""
