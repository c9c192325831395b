"""Operators: DataFrame in, DataFrame out.  Order, where it matters, is given by key columns."""
