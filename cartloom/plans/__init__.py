"""Bindings of the given tables to the model tables, registered queries and their SQL checks."""
