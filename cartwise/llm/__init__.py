"""Operators of a training-data pipeline.

Nothing else in the library imports this package.  Each module holds one operator
with a general interface; ``queries`` registers one thin query for each of them.
"""
