"""Operators of a training-data pipeline over document and vector tables.

Nothing else in the library imports this subpackage.
"""
