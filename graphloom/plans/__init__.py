"""Queries over the driver tables, and the operation dispatcher."""
