"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
column names and returns DataFrames; the ``opN_*`` queries in
:mod:`graphquarry.llm.queries` are thin wrappers that derive digests.
"""
