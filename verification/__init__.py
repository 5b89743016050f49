"""Registered queries and the SQL their results must equal."""
