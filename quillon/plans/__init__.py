"""Bindings of the operators to tables, and the registry of queries with their SQL oracles."""
