"""Registered queries with their SQL twins, family by family."""
