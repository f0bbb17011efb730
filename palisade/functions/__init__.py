"""Scalar functions and predicates."""
