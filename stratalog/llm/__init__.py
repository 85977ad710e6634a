"""Operators of a training-data pipeline over documents and web pages.

Nothing outside this package imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin production queries.
"""
