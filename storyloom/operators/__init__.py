"""Analytic operators, one module per group of computations."""
