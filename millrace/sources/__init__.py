"""Readers of corpora, queries and annotation sheets; writers of tables and reports; the store of results."""
