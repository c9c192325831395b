"""Queries over the test tables and the graph that strings operators together."""
