"""Queries over the TPC-H-like tables: the operators, applied, with their SQL."""
