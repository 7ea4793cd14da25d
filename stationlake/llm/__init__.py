"""Corpus operators for training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes a
DataFrame and column names, selects the columns it needs up front (other
columns may have any name) and returns a DataFrame; `queries.py` holds the
registered `opN_<name>` queries, `oracle.py` their SQL.
"""
