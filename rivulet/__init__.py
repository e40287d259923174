"""Incremental stream analytics on PySpark."""

from .functions import agg, call, duration, expr, fields, if_else, lit, map_option, none_of, record, tuple_of, unpack
from .plans.stream import GroupedStream, RecordWindow, Stream, TimeWindowed

__all__ = [
    "GroupedStream", "RecordWindow", "Stream", "TimeWindowed", "agg", "call", "duration", "expr", "fields", "if_else", "lit",
    "map_option", "none_of", "record", "tuple_of", "unpack",
]
