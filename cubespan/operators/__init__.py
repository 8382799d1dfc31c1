"""Operators on temporal cubes."""
