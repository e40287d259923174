"""Arrival order as columns.

A stream carries its order in hidden columns ``_o0, _o1, ...``; together they
are unique.  Group keys are hidden columns ``_k0, _k1, ...``, outermost first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)


def earliest(order: list[str]) -> Column:
    return F.struct(*order)


def reversed_order(df: DataFrame, order: list[str]) -> Column:
    """A struct that orders records from the last to the first."""
    out = []
    for c in order:
        kind = df.schema[c].dataType
        if isinstance(kind, _NUMBERS):
            out.append(-F.col(c))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            out.append(-F.unix_micros(F.col(c).cast("timestamp")))
        elif isinstance(kind, T.DateType):
            out.append(-F.unix_date(c))
        else:
            raise TypeError(f"argmax, argmin and max_by need an order of numbers or times, not {kind.simpleString()}")
    return F.struct(*out)
