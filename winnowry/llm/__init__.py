"""Training-data operators: ten components for very large text corpora.

Nothing outside this subpackage imports it; its queries are listed in ``queries.py``.
"""
