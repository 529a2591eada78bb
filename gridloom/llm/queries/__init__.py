"""Registered queries of the training-data operators: every module has QUERIES and SQL."""
