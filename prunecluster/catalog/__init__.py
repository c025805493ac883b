"""Queries over the given tables, one or more per operator, and their SQL twins."""
