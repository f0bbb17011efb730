"""Operators beyond plain relational algebra."""
