"""Operators for preparing training data at scale.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns DataFrames; ``queries`` holds the thin queries over the test tables.
"""
