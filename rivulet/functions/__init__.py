"""Scalar expressions and aggregates."""

from . import aggregates as agg
from .expr import (
    Expr,
    call,
    duration,
    expr,
    fields,
    if_else,
    lit,
    map_option,
    none_of,
    record,
    tuple_of,
    unpack,
)

__all__ = [
    "Expr", "agg", "call", "duration", "expr", "fields", "if_else", "lit", "map_option", "none_of", "record", "tuple_of", "unpack",
]
