"""Registered queries and their SQL: every module has QUERIES and SQL."""
