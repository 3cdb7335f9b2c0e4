"""Pipelines over stored tables, and the registry of queries over the test tables."""
