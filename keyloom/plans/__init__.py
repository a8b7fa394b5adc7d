"""Declared schemas, predicates and the choice of access paths."""
