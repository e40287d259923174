"""Aggregation of groups and of time windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates
from ..functions.expr import expr
from ..plans import order as orders
from ..plans.stream import GroupedStream, Stream, TimeWindowed, _key_binding
from .running import up_to_now


def select(stream: Stream, keys: list[str], key: str, made: dict, emit: str) -> Stream:
    """``keys``: all key columns, outermost first; ``key``: the one that functions get."""
    made = {k: expr(v) for k, v in made.items()}
    aggregates.check(made)
    if stream.streaming:
        if emit != "running":
            raise ValueError("on a stream, groups emit running values")
        from ..streaming import lowering

        return lowering.running_select(stream, keys, key, made)
    first, last = orders.earliest(stream.order), None
    if any(isinstance(n, aggregates.Aggregate) and n.kind == "argmax" for e in made.values() for n in e.walk()):
        last = orders.reversed_order(stream.df, stream.order)
    env = stream.env(key=_key_binding(key))
    if emit == "final":
        env["__aggregate__"] = lambda a: a.column(env, first, last)
        cols = [e.lower(env).alias(n) for n, e in made.items()]
        latest = F.max(F.struct(*stream.order)).alias("_last")
        out = stream.df.groupBy(*keys).agg(*cols, latest) if keys else stream.df.agg(*cols, latest)
        df = out.select(*made, *stream.ctx, *(F.col("_last").getField(c).alias(c) for c in stream.order))
        return stream._with(df, list(made))
    if emit != "running":
        raise ValueError("emit is 'running' or 'final'")
    w = up_to_now(keys, stream.order)
    env["__aggregate__"] = lambda a: a.column(env, first, last).over(w)
    cols = [e.lower(env).alias(n) for n, e in made.items()]
    return stream._with(stream.df.select(*cols, *stream.ctx, *stream.order), list(made))


def select_streaming_window(windowed: TimeWindowed, made: dict) -> Stream:
    """Structured Streaming's own windowed aggregation, updated at each micro-batch."""
    s = windowed.stream
    made = {k: expr(v) for k, v in made.items()}
    aggregates.check(made)
    env = s.env(key=_key_binding("_start"))
    first, last = orders.earliest(s.order), orders.reversed_order(s.df, s.order)
    env["__aggregate__"] = lambda a: a.column(env, first, last)
    window = F.window("_t", windowed.size, windowed.slide).alias("_w") if windowed.size != windowed.slide else F.window("_t", windowed.size).alias("_w")
    keys = [*s.ctx, *windowed.keys]
    out = s.df.drop("_w").groupBy(*keys, window).agg(
        *(e.lower({**env, "key": _key_binding("_w.start")}).alias(n) for n, e in made.items()), F.max(F.struct(*s.order)).alias("_last")
    )
    df = out.select(*made, *s.ctx, *(F.col("_last").getField(c).alias(c) for c in s.order))
    return s._with(df, list(made))


def apply_whole(stream: Stream, keys: list[str], fn: Callable[[list[dict]], dict], schema: str) -> Stream:
    """A function of all records of each key, in order; one row for each.

    Memory of a task: the records of one key, as the function asks for them all.
    """
    order, columns, ctx = stream.order, stream.columns, stream.ctx
    names = T._parse_datatype_string(schema).names
    kinds = {c: stream.df.schema[c].dataType.simpleString() for c in [*ctx, *order]}
    out = ", ".join([schema, *(f"{c} {k}" for c, k in kinds.items())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        made = fn(pdf[columns].to_dict("records"))
        end = pdf.iloc[-1]
        return pd.DataFrame([{**{n: made[n] for n in names}, **{c: end[c] for c in [*ctx, *order]}}])

    df = stream.df.select(*columns, *keys, *order).groupBy(*keys).applyInPandas(run, out)
    return stream._with(df, list(names))


def unique(grouped: GroupedStream, value: Callable) -> GroupedStream:
    """The latest record for each value within each group.

    For bounded input: of records with an equal value only the last remains,
    in its own place of the order.
    """
    s = grouped.stream
    keys = [*s.ctx, grouped.key]
    df = s.df.withColumn("_u", s.lower(value))
    best = df.groupBy(*keys, "_u").agg(F.max_by(F.struct(*s.columns), F.struct(*s.order)).alias("_r"), F.max(F.struct(*s.order)).alias("_last"))
    out = best.select("_r.*", *keys, *(F.col("_last").getField(c).alias(c) for c in s.order))
    return GroupedStream(s._with(out, s.columns), grouped.key)
