"""Readers that turn files and tables into graph rows."""
