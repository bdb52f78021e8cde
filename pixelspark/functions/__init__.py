"""Scalar functions as Column expressions: colour, tone curves and integer signal maths."""
