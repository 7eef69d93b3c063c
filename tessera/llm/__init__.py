"""Operators for large text corpora: each module holds one operator, queries.py the registered queries."""
