"""Queries over the driver tables: the operators bound to tables, and their SQL."""
