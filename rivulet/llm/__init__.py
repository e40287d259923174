"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator is a
plain function over DataFrames; ``queries`` holds the thin registered queries.
"""
