"""Derived tables and the registered queries, module by module."""
