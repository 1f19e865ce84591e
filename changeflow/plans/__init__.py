"""Composite queries, one plan for each endpoint."""
