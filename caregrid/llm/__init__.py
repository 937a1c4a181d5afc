"""Operators that prepare training corpora.

Nothing else in the library imports this package. Every operator takes and
returns DataFrames; see ``registry`` for the queries built on them.
"""
