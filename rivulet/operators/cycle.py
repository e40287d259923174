"""Feedback: a stream's output becomes its input until nothing is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..plans.stream import Stream
from ..plans.work import written


def cycle(start: Stream, body: Callable[[Stream], Stream], most: int = 10_000) -> Stream:
    """All records that ``body`` gives, of the start and then of its own output.

    Each round is written to the shared folder, so the plan does not grow and a
    lost executor costs no earlier round.  Order: round, then order in it.
    """
    out: Stream | None = None
    current = start
    for turn in range(most):
        made = body(current)
        df = written(made.df.select(*made.columns, *made.order), f"cycle-{turn}")
        if df.isEmpty():
            break
        current = Stream(df, made.columns, made.order)
        fresh = [f"_o{i}" for i in range(len(made.order) + 1)]
        placed = df.select(*made.columns, F.lit(turn).alias(fresh[0]), *(F.col(c).alias(n) for c, n in zip(made.order, fresh[1:], strict=True)))
        out = Stream(placed, made.columns, fresh) if out is None else Stream(out.df.unionByName(placed), made.columns, fresh)
    else:
        raise RuntimeError(f"the cycle did not end in {most} rounds")
    if out is None:
        made = body(start)
        return Stream(made.df.limit(0), made.columns, made.order)
    return out
