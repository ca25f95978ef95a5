"""Operators for building language-model training data on Spark.

Nothing outside this folder imports it; its queries are in ``queries.py``.
"""
