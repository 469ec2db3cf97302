"""Operators of a training-data pipeline over ``documents``-like tables.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own interface; ``queries`` binds the operators to the
supplied tables.
"""
