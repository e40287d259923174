"""Lowerings of the operators to window functions, aggregates and joins."""
