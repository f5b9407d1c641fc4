"""Scalar expressions: hybrid logical clocks, values, identifiers."""
