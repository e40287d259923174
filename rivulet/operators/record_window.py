"""The last n records of every group, seen after each arrival.

Sums, counts and means never gather a window: each group's own frame value is
taken over its last n records, and the change it makes at each arrival is
summed over all groups in arrival order.  ``any`` follows the first group.
Other aggregates and ``apply`` walk through the records of a context key.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates
from ..functions.expr import expr
from ..plans.stream import RecordWindow, Stream
from .running import last_n, ordered, up_to_now
from .scans import _plain, scan

_NATIVE = {"sum", "count", "mean", "any"}


def select(window: RecordWindow, made: dict[str, Any]) -> Stream:
    s, key, n = window.grouped.stream, window.grouped.key, window.n
    made = {k: expr(v) for k, v in made.items()}
    aggregates.check(made)
    nodes = [x for e in made.values() for x in e.walk() if isinstance(x, aggregates.Aggregate)]
    if s.streaming or any(x.kind not in _NATIVE for x in nodes):
        return _walk_select(window, made, nodes)
    env, df = s.env(), s.df
    group = [*s.ctx, key]
    frame, run = last_n(group, s.order, n), up_to_now(s.ctx, s.order)
    values: dict[int, Column] = {}
    count = [0]

    def change(value: Column) -> Column:
        """The running sum over all groups of what each group's frame value changes by."""
        nonlocal df
        i = count[0]
        count[0] += 1
        df = df.withColumn(f"_f{i}", F.coalesce(value.over(frame), F.lit(0)))
        df = df.withColumn(f"_d{i}", F.col(f"_f{i}") - F.coalesce(F.lag(f"_f{i}").over(ordered(group, s.order)), F.lit(0)))
        return F.sum(f"_d{i}").over(run)

    for x in nodes:
        a = x.args[0].lower(env) if x.args else None
        if x.kind == "sum":
            held = change(F.count(a))
            values[id(x)] = F.when(held > 0, change(F.sum(a)))
        elif x.kind == "count":
            values[id(x)] = change(F.count(F.lit(1)))
        elif x.kind == "mean":
            values[id(x)] = change(F.sum(a)) / change(F.count(a))
        else:
            i = count[0]
            count[0] += 1
            df = df.withColumn(f"_g{i}", F.first(key).over(run))
            oldest = F.first(F.struct(a.alias("v"))).over(frame)
            df = df.withColumn(f"_f{i}", oldest)
            df = df.withColumn(f"_f{i}", F.when(F.col(key).eqNullSafe(F.col(f"_g{i}")), F.col(f"_f{i}")))
            values[id(x)] = F.last(f"_f{i}", ignorenulls=True).over(run).getField("v")
    env["__aggregate__"] = lambda x: values[id(x)]
    cols = [e.lower(env).alias(k) for k, e in made.items()]
    return s._with(df.select(*cols, *s.ctx, *s.order), list(made))


class _Contents:
    """The last n records of every group, groups in the order they came."""

    def __init__(self, n: int) -> None:
        self.n, self.groups = n, OrderedDict()

    def add(self, key: Any, row: dict) -> list[dict]:
        if key not in self.groups:
            self.groups[key] = deque(maxlen=self.n)
        self.groups[key].append(row)
        return [r for g in self.groups.values() for r in g]


def apply(window: RecordWindow, fn: Callable[[list[dict]], dict], schema: str) -> Stream:
    s, key = window.grouped.stream, window.grouped.key
    columns = s.columns
    inner = s._with(s.df.withColumn("_g", F.col(key)).select(*columns, "_g", *s.ctx, *s.order), [*columns, "_g"])

    def step(state: _Contents, r: dict) -> tuple[_Contents, dict]:
        return state, fn(state.add(_plain(r["_g"]), {c: r[c] for c in columns}))

    return scan(inner, _Contents(window.n), step, schema)


def flat_map(window: RecordWindow, fn: Callable[[list[dict]], Iterable[dict]], schema: str) -> Stream:
    names = T._parse_datatype_string(schema).names
    many = T._parse_datatype_string(schema).simpleString()
    found = apply(window, lambda rows: {"_made": [{n: r.get(n) for n in names} for r in fn(rows)]}, f"_made array<{many}>")
    place = f"_o{len(found.order)}"
    df = found.df.select(*found.ctx, *found.order, F.posexplode("_made").alias(place, "_one"))
    df = df.select(*(F.col("_one").getField(n).alias(n) for n in names), *found.ctx, *found.order, place)
    return Stream(df, names, [*found.order, place], found.ctx, found.name, found.node_id)


def _walk_select(window: RecordWindow, made: dict, nodes: list) -> Stream:
    s, key = window.grouped.stream, window.grouped.key
    env = s.env()
    args = {f"_a{i}_{j}": a.lower(env) for i, x in enumerate(nodes) for j, a in enumerate(x.args)}
    df = s.df.select(*(c.alias(n) for n, c in args.items()), F.col(key).alias("_g"), *s.ctx, *s.order)
    inner = s._with(df, [*args, "_g"])
    kinds = []
    for i, x in enumerate(nodes):
        kind = "bigint" if x.kind == "count" else "double" if x.kind == "mean" else df.schema[f"_a{i}_{1 if x.kind.startswith('arg') else 0}"].dataType.simpleString()
        if x.kind == "sum" and kind in ("int", "smallint", "tinyint"):
            kind = "bigint"
        kinds.append(f"_v{i} {kind}")
    shapes = [x.kind for x in nodes]

    def step(state: _Contents, r: dict) -> tuple[_Contents, dict]:
        rows = state.add(_plain(r["_g"]), r)
        return state, {f"_v{i}": _value(k, [x.get(f"_a{i}_0") for x in rows], [x.get(f"_a{i}_1") for x in rows]) for i, k in enumerate(shapes)}

    out = scan(inner, _Contents(window.n), step, ", ".join(kinds))
    places = {id(x): F.col(f"_v{i}") for i, x in enumerate(nodes)}
    env = out.env()
    env["__aggregate__"] = lambda x: places[id(x)]
    cols = [e.lower(env).alias(k) for k, e in made.items()]
    return out._with(out.df.select(*cols, *out.ctx, *out.order), list(made))


def _value(kind: str, a: list, b: list) -> Any:
    if kind == "count":
        return len(a)
    if kind == "any":
        return a[0]
    real = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and not (isinstance(x, float) and x != x)]
    if not real:
        return None
    xs = [x for x, _ in real]
    if kind == "sum":
        return sum(xs)
    if kind == "mean":
        return float(sum(xs)) / len(xs)
    if kind in ("min", "max"):
        return min(xs) if kind == "min" else max(xs)
    best = max(xs) if kind == "argmax" else min(xs)
    return next(y for x, y in real if x == best)


