"""Scalar helpers: units, complex numbers as pairs of columns."""
