"""Runs over queries that arrive."""
