"""Readers and writers for orders, catalogues, rules, lookups and models."""
