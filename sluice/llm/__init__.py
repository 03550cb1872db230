"""Operators for building training corpora: nothing outside this subpackage imports it.

Every operator takes a DataFrame and returns one; `queries` holds the thin queries that apply them to
the tables of a data folder.
"""
