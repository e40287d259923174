"""Running operators: sum_by, max_by, min_by, last, general folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import Arg, Binding, expr
from ..plans import order as orders
from ..plans.stream import Stream
from .running import before_now, up_to_now


def _running(stream: Stream, value: Callable, make: Callable, over: Callable[[Column], Column]) -> Stream:
    if stream.streaming:
        from ..streaming import lowering

        return lowering.running_value(stream, value, make, over)
    df = stream.df.withColumn("_v", over(stream.lower(value)).over(up_to_now(stream.ctx, stream.order)))
    env = stream.env(v=Binding(F.col, T.StructType(), lambda: F.col("_v")))
    made = make(Arg("r"), Arg("v"))
    cols = [expr(e).lower(env).alias(n) for n, e in made.items()]
    return stream._with(df.select(*cols, *stream.ctx, *stream.order), list(made))


def sum_by(stream: Stream, value: Callable, make: Callable) -> Stream:
    return _running(stream, value, make, F.sum)


def mean_by(stream: Stream, value: Callable, make: Callable) -> Stream:
    return _running(stream, value, make, F.avg)


def product_by(stream: Stream, value: Callable, make: Callable) -> Stream:
    return _running(stream, value, make, F.product)


def best_by(stream: Stream, value: Callable, emit: str, largest: bool) -> Stream:
    """``changes``: records strictly better than all before; ``all``: the best so far, of equals the first."""
    if emit not in ("changes", "all"):
        raise ValueError("emit is 'changes' or 'all'")
    if stream.streaming:
        from ..streaming import lowering

        return lowering.best_by(stream, value, emit, largest)
    df = stream.df.withColumn("_v", stream.lower(value))
    pick = F.max if largest else F.min
    if emit == "changes":
        seen = pick("_v").over(before_now(stream.ctx, stream.order))
        better = (F.col("_v") > F.col("_m")) if largest else (F.col("_v") < F.col("_m"))
        out = df.withColumn("_m", seen).where(F.col("_m").isNull() | better)
        return stream._with(out.select(*stream.columns, *stream.ctx, *stream.order), stream.columns)
    w = up_to_now(stream.ctx, stream.order)
    row = F.struct(*stream.columns)
    if largest:
        best = F.max_by(row, F.struct("_v", orders.reversed_order(df, stream.order)))
    else:
        best = F.min_by(row, F.struct("_v", orders.earliest(stream.order)))
    out = df.select(best.over(w).alias("_b"), *stream.ctx, *stream.order)
    return stream._with(out.select("_b.*", *stream.ctx, *stream.order), stream.columns)


def last(stream: Stream) -> Stream:
    """The record with the greatest order of each context key."""
    row = F.max_by(F.struct(*stream.columns, *stream.order), F.struct(*stream.order)).alias("_r")
    df = stream.df.groupBy(*stream.ctx).agg(row) if stream.ctx else stream.df.agg(row).where("_r IS NOT NULL")
    return stream._with(df.select("_r.*", *stream.ctx).select(*stream.columns, *stream.ctx, *stream.order), stream.columns)


def scan(stream: Stream, initial: Any, step: Callable[[Any, dict], tuple[Any, dict | None]], schema: str) -> Stream:
    """A fold in arrival order with an output for each record (or none, where ``step`` gives None).

    The state is a Python value; the records of a key pass through in Arrow
    batches, so a task holds one state and one batch of its keys.
    """
    if stream.streaming:
        from ..streaming import lowering

        return lowering.scan(stream, initial, step, schema)
    columns, ctx, order = stream.columns, stream.ctx, stream.order
    names = T._parse_datatype_string(schema).names
    out = ", ".join([schema, *(f"{c} {stream.df.schema[c].dataType.simpleString()}" for c in [*ctx, *order])])
    keyed = [*columns, *ctx, *order]

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        import copy

        key, state = None, None
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                now = tuple(map(_plain, (r[c] for c in ctx)))
                if key is None or now != key:
                    key, state = now, copy.deepcopy(initial)
                state, made = step(state, {c: r[c] for c in columns})
                if made is not None:
                    rows.append({**{n: made[n] for n in names}, **{c: r[c] for c in [*ctx, *order]}})
            yield pd.DataFrame(rows, columns=[*names, *ctx, *order])

    df = stream.df.select(*keyed)
    df = (df.repartition(*ctx) if ctx else df.coalesce(1)).sortWithinPartitions(*ctx, *order)
    return stream._with(df.mapInPandas(run, out), list(names))


def _plain(x: Any) -> Any:
    return tuple(sorted((k, _plain(v)) for k, v in x.items())) if isinstance(x, dict) else x


def reduce_records(stream: Stream, step: Callable[[dict, dict], dict]) -> Stream:
    def fold(state: dict | None, r: dict) -> tuple[dict, dict]:
        made = r if state is None else step(state, r)
        return made, made

    schema = ", ".join(f"{c} {stream.df.schema[c].dataType.simpleString()}" for c in stream.columns)
    return scan(stream, None, fold, schema)
