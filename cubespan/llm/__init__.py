"""Operators for preparing training text at scale.

Every operator takes and returns DataFrames. Nothing else in the library imports this subpackage.
"""
