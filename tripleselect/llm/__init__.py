"""Operators of a training-data pipeline over a ``documents`` table.

One module per operator, each with a general DataFrame-in / DataFrame-out
interface; ``queries.py`` holds the thin registered queries and ``oracles.py``
their SQL.  Nothing outside this package imports it.
"""
