"""Operators for preparing language-model training text, one module each.

Nothing outside this package imports it.  Every module exposes a general
operator, a ``query(spark, sf_dir)`` that applies it to its whole table, and,
where SQL can say the same, an ``ORACLE_SQL`` string.
"""
