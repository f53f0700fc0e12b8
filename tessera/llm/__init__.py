"""Operators for building training corpora.

Nothing outside this subpackage imports it. Every operator takes a DataFrame
and column names, selects what it needs under names of its own (so extra or
clashing columns never matter) and returns a DataFrame.
"""
