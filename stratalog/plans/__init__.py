"""Queries over whole tables, bound to the driver's fixtures."""
