"""Operators on tables of keys and cells."""
