"""Operators of a training-data pipeline: one module each, queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
