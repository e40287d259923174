"""Union of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.stream import Stream


def union(a: Stream, b: Stream) -> Stream:
    """Bag union in the merged order; at equal places ``a`` comes first."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"records differ: {a.columns} and {b.columns}")
    if len(a.order) != len(b.order) or a.ctx != b.ctx:
        raise ValueError("the streams are ordered or grouped in different ways")
    side = f"_o{len(a.order)}"
    cols = [*a.columns, *a.ctx, *a.order]
    df = a.df.select(*cols, F.lit(0).alias(side)).unionByName(b.df.select(*cols, F.lit(1).alias(side)))
    return a._with(df, a.columns, order=[*a.order, side])
