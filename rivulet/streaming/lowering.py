"""The stateful operators on streaming DataFrames.

Expressions stay in the JVM: arguments are computed before the fold and
results are built after it; the fold itself only moves running values.  Whole
records pass through it as JSON text, which keeps their types exact.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Aggregate
from ..functions.expr import Arg, Binding, expr
from ..plans.stream import Stream, _key_binding
from .fold import fold


def _missing(x: Any) -> bool:
    return x is None or (isinstance(x, float) and x != x) or x is getattr(__import__("pandas"), "NaT", None)


def _comparable(x: Any) -> Any:
    if isinstance(x, dict):
        return tuple(x.values())
    return tuple(x) if isinstance(x, (list, tuple)) or hasattr(x, "asDict") else x


def _advance(kind: str, state: Any, args: list[Any]) -> tuple[Any, Any]:
    """One aggregate's new state and value."""
    if kind == "count":
        n = (state or 0) + 1
        return n, n
    if kind == "any":
        state = state if state is not None else (args[0],)
        return state, state[0]
    x = args[0]
    if kind in ("argmax", "argmin"):
        if not _missing(x):
            x = _comparable(x)
            if state is None or (x > state[0] if kind == "argmax" else x < state[0]):
                state = (x, args[1])
        return state, state[1] if state else None
    if not _missing(x):
        if kind == "sum":
            state = x if state is None else state + x
        elif kind == "product":
            state = float(x) if state is None else state * x
        elif kind == "mean":
            state = (x, 1) if state is None else (state[0] + x, state[1] + 1)
        elif kind == "min":
            state = x if state is None else min(state, x)
        else:
            state = x if state is None else max(state, x)
    return state, (float(state[0]) / state[1] if state else None) if kind == "mean" else state


def _kind_of(kind: str, types: list[T.DataType]) -> str:
    if kind == "count":
        return "bigint"
    if kind in ("mean", "product"):
        return "double"
    t = types[1 if kind.startswith("arg") else 0]
    if kind == "sum":
        return "bigint" if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else "double"
    return t.simpleString()


def _values(df: DataFrame, keys: list[str], order: list[str], kinds: list[str], args: list[list[str]], carried: list[str]) -> DataFrame:
    """Running values ``_v0, _v1, ...`` of several aggregates."""
    made = ", ".join(f"_v{i} {_kind_of(k, [df.schema[c].dataType for c in a])}" for i, (k, a) in enumerate(zip(kinds, args, strict=True)))

    def step(state: list, r: dict) -> tuple[list, list[dict]]:
        moved = [_advance(k, s, [r[c] for c in a]) for k, s, a in zip(kinds, state, args, strict=True)]
        return [m[0] for m in moved], [{f"_v{i}": m[1] for i, m in enumerate(moved)}]

    return fold(df, keys, order, [c for a in args for c in a], made, [None] * len(kinds), step, carried)


def running_select(stream: Stream, keys: list[str], key: str, made: dict) -> Stream:
    env = stream.env(key=_key_binding(key))
    nodes = [x for e in made.values() for x in e.walk() if isinstance(x, Aggregate)]
    args = [[f"_a{i}_{j}" for j in range(len(x.args))] for i, x in enumerate(nodes)]
    df = stream.df.withColumns({n: a.lower(env) for x, names in zip(nodes, args, strict=True) for n, a in zip(names, x.args, strict=True)})
    out = _values(df, keys, stream.order, [x.kind for x in nodes], args, keys)
    places = {id(x): F.col(f"_v{i}") for i, x in enumerate(nodes)}
    env["__aggregate__"] = lambda x: places[id(x)]
    cols = [e.lower(env).alias(n) for n, e in made.items()]
    return stream._with(out.select(*cols, *stream.ctx, *stream.order), list(made))


def _packed(stream: Stream) -> DataFrame:
    return stream.df.withColumn("_row", F.to_json(F.struct(*stream.columns)))


def _unpacked(stream: Stream) -> Any:
    return F.from_json("_row", stream.df.select(*stream.columns).schema)


def running_value(stream: Stream, value: Callable, make: Callable, over: Callable) -> Stream:
    kind = {F.sum: "sum", F.avg: "mean", F.product: "product"}[over]
    df = _packed(stream).withColumn("_a", stream.lower(value))
    out = _values(df, stream.ctx, stream.order, [kind], [["_a"]], [*stream.ctx, "_row"]).withColumn("_r", _unpacked(stream))
    schema = stream.df.select(*stream.columns).schema
    env = {
        "r": Binding(lambda n: F.col("_r").getField(n), schema, lambda: F.col("_r")),
        "v": Binding(F.col, T.StructType(), lambda: F.col("_v0")),
    }
    made = make(Arg("r"), Arg("v"))
    return stream._with(out.select(*(expr(e).lower(env).alias(n) for n, e in made.items()), *stream.ctx, *stream.order), list(made))


def best_by(stream: Stream, value: Callable, emit: str, largest: bool) -> Stream:
    df = _packed(stream).withColumn("_a", stream.lower(value))

    def step(state: Any, r: dict) -> tuple[Any, list[dict]]:
        x = r["_a"]
        better = not _missing(x) and (state is None or (_comparable(x) > state[0] if largest else _comparable(x) < state[0]))
        if better or state is None:
            state = (_comparable(x), r["_row"]) if not _missing(x) else state
            row = r["_row"]
            return state, [{"_row": row}]
        return state, [{"_row": state[1]}] if emit == "all" else []

    out = fold(df, stream.ctx, stream.order, ["_a", "_row"], "_row string", None, step, stream.ctx)
    return stream._with(out.withColumn("_r", _unpacked(stream)).select("_r.*", *stream.ctx, *stream.order), stream.columns)


def scan(stream: Stream, initial: Any, step: Callable, schema: str) -> Stream:
    columns = stream.columns

    def one(state: Any, r: dict) -> tuple[Any, list[dict]]:
        state, made = step(state, {c: r[c] for c in columns})
        return state, [] if made is None else [made]

    out = fold(stream.df, stream.ctx, stream.order, columns, schema, initial, one, stream.ctx)
    return stream._with(out, T._parse_datatype_string(schema).names)


def join_pairs(joined) -> tuple[DataFrame, list[str], list[str]]:  # noqa: ANN001
    """The pairs of a join of two streaming sides."""
    table, keys, order = joined._tagged()
    if joined.kind == "waiting" and joined.condition.post is not None:
        raise NotImplementedError("a waiting join with a condition across both sides runs on bounded input only")
    env, kind = joined._env(), joined.kind
    ctx = [k for k in keys if k.startswith("_k")]
    df = table.withColumn("_row", F.when(F.col("_side") == 1, F.to_json("_l")).otherwise(F.to_json("_r"))).drop("_l", "_r")
    df = df.withColumns({k: F.to_json(F.struct(k)) for k in keys if not k.startswith("_k")})

    def step(state: dict, r: dict) -> tuple[dict, list[dict]]:
        left = r["_side"] == 1
        if kind == "waiting":
            if left:
                if state["r"] is None:
                    state["wait"].append(r["_row"])
                    return state, []
                return state, [{"_lj": r["_row"], "_rj": state["r"]}]
            state["r"] = r["_row"]
            out = [{"_lj": x, "_rj": r["_row"]} for x in state["wait"]]
            state["wait"] = []
            return state, out
        state["l" if left else "r"] = r["_row"]
        if kind == "left":
            return state, [{"_lj": r["_row"], "_rj": state["r"]}] if left else []
        return state, [{"_lj": state["l"], "_rj": state["r"]}]

    first = {"l": None, "r": None, "wait": []}
    out = fold(df, keys, order, ["_row", "_side"], "_lj string, _rj string", first, step, ctx)
    out = out.withColumn("_l", F.from_json("_lj", env["l"].schema)).withColumn("_r", F.from_json("_rj", env["r"].schema))
    if joined.condition.post is not None:
        out = out.where(joined.condition.post.lower(env))
    return out.select("_l", "_r", *ctx, *order), ctx, order
