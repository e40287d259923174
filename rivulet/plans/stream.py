"""The fluent API: Stream and the builders it leads to.

A Stream is a DataFrame whose rows have an arrival order and, inside the body
of a grouped ``flat_map`` or ``map``, the keys of the groups around it.
Nothing is executed here: every method returns a lazy plan of window
functions, aggregates and joins.  Streaming DataFrames take the same calls;
operators that keep state are then lowered to stateful processors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import Arg, Binding, Expr, expr

Fields = dict[str, Any]


class Stream:
    def __init__(self, df: DataFrame, columns: list[str], order: list[str], ctx: list[str] | None = None, name: str | None = None, node_id: str | None = None) -> None:
        self.df, self.columns, self.order, self.ctx = df, columns, order, ctx or []
        self.name, self.node_id = name, node_id

    # -- making and naming ------------------------------------------------

    @classmethod
    def from_df(cls, df: DataFrame, order_by: Iterable[str] | str, name: str | None = None) -> Stream:
        """``order_by``: columns that together order the records and are unique."""
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        hidden = [F.col(c).alias(f"_o{i}") for i, c in enumerate(keys)]
        return cls(df.select(*df.columns, *hidden), list(df.columns), [f"_o{i}" for i in range(len(keys))], name=name)

    @classmethod
    def of_fields(cls, df: DataFrame, order_by: Iterable[str] | str, *names: str) -> Stream:
        """A stream of some named fields of ``df``, ordered by columns that need not be among them."""
        whole = cls.from_df(df, order_by)
        return whole._with(whole.df.select(*names, *whole.order), list(names))

    @classmethod
    def of_list(cls, spark: SparkSession, rows: Iterable[tuple], schema: str) -> Stream:
        """A list source: the records in the order given."""
        listed = [(*r, i) for i, r in enumerate(rows)]
        df = spark.createDataFrame(listed, f"{schema}, _o0 bigint")
        return cls(df, [c for c in df.columns if c != "_o0"], ["_o0"])

    def _with(self, df: DataFrame, columns: list[str], **change: Any) -> Stream:
        return Stream(df, columns, change.get("order", self.order), change.get("ctx", self.ctx), self.name, self.node_id)

    def with_name(self, name: str) -> Stream:
        return Stream(self.df, self.columns, self.order, self.ctx, name, self.node_id)

    def with_id(self, node_id: str) -> Stream:
        return Stream(self.df, self.columns, self.order, self.ctx, self.name, node_id)

    @property
    def streaming(self) -> bool:
        return self.df.isStreaming

    def to_df(self, with_order: bool = False) -> DataFrame:
        """The records' own columns; ``with_order`` keeps the hidden order columns too."""
        return self.df.select(*self.columns, *(self.order if with_order else []))

    # -- binding ----------------------------------------------------------

    def binding(self) -> Binding:
        return Binding(F.col, self.df.select(*self.columns).schema, lambda: F.struct(*self.columns))

    def env(self, **more: Any) -> dict[str, Any]:
        return {"r": self.binding(), **more}

    def lower(self, fn: Callable[..., Any], *args: Any) -> Column:
        return expr(fn(Arg("r"), *args)).lower(self.env())

    def _named(self, made: Any) -> Fields:
        if isinstance(made, dict):
            return made
        raise TypeError("give named fields: fields(a=..., b=...)")

    # -- projection and filter ---------------------------------------------

    def map(self, fn: Callable[[Arg], Fields]) -> Stream:
        """One record for each: ``fn`` names the new fields."""
        made, env = self._named(fn(Arg("r"))), self.env()
        cols = [expr(v).lower(env).alias(k) for k, v in made.items()]
        return self._with(self.df.select(*cols, *self.ctx, *self.order), list(made))

    def to_field(self, name: str) -> Stream:
        """The whole record as one field."""
        return self._with(self.df.select(F.struct(*self.columns).alias(name), *self.ctx, *self.order), [name])

    def add_fields(self, fn: Callable[[Arg], Fields]) -> Stream:
        made, env = self._named(fn(Arg("r"))), self.env()
        if clash := set(made) & set(self.columns):
            raise ValueError(f"fields that are there already: {sorted(clash)}")
        cols = [expr(v).lower(env).alias(k) for k, v in made.items()]
        return self._with(self.df.select(*self.columns, *cols, *self.ctx, *self.order), [*self.columns, *made])

    def where(self, fn: Callable[[Arg], Expr]) -> Stream:
        return self._with(self.df.where(self.lower(fn)), self.columns)

    def explode(self, fn: Callable[[Arg], Expr], name: str) -> Stream:
        """Scalar flat-map: a record for each element of an array, with it as a further field."""
        n = f"_o{len(self.order)}"
        df = self.df.select("*", F.posexplode(self.lower(fn)).alias(n, name))
        return self._with(df.select(*self.columns, name, *self.ctx, *self.order, n), [*self.columns, name], order=[*self.order, n])

    # -- grouping and windows -----------------------------------------------

    def group_by(self, fn: Callable[[Arg], Any]) -> GroupedStream:
        k = f"_k{len(self.ctx)}"
        df = self.df.withColumn(k, self.lower(fn))
        return GroupedStream(self._with(df, self.columns), k)

    def tumbling_window(self, fn: Callable[[Arg], Expr], period: str, offset: str = "0 seconds") -> TimeWindowed:
        return TimeWindowed(self, fn, period, period, offset, [])

    def sliding_window(self, fn: Callable[[Arg], Expr], size: str, slide: str, offset: str = "0 seconds") -> TimeWindowed:
        return TimeWindowed(self, fn, size, slide, offset, [])

    # -- running operators ----------------------------------------------------

    def sum_by(self, value: Callable[[Arg], Expr], make: Callable[[Arg, Expr], Fields]) -> Stream:
        from ..operators import scans

        return scans.sum_by(self, value, make)

    def mean_by(self, value: Callable[[Arg], Expr], make: Callable[[Arg, Expr], Fields]) -> Stream:
        from ..operators import scans

        return scans.mean_by(self, value, make)

    def product_by(self, value: Callable[[Arg], Expr], make: Callable[[Arg, Expr], Fields]) -> Stream:
        from ..operators import scans

        return scans.product_by(self, value, make)

    def max_by(self, value: Callable[[Arg], Any], emit: str = "changes") -> Stream:
        """``changes``: a record when it beats all before it; ``all``: the best so far at every record."""
        from ..operators import scans

        return scans.best_by(self, value, emit, largest=True)

    def min_by(self, value: Callable[[Arg], Any], emit: str = "changes") -> Stream:
        from ..operators import scans

        return scans.best_by(self, value, emit, largest=False)

    def scan(self, initial: Any, step: Callable[[Any, dict], tuple[Any, dict | None]], schema: str) -> Stream:
        from ..operators import scans

        return scans.scan(self, initial, step, schema)

    def reduce(self, step: Callable[[dict, dict], dict]) -> Stream:
        """Fold records with each other; the first is emitted as it is."""
        from ..operators import scans

        return scans.reduce_records(self, step)

    def last(self) -> Stream:
        """The last record of each context key, when the input ends."""
        from ..operators import scans

        return scans.last(self)

    # -- several streams --------------------------------------------------------

    def union(self, other: Stream) -> Stream:
        from ..operators import sets

        return sets.union(self, other)

    def left_join(self, other: Stream | RecordWindow | TimeWindowed) -> Any:
        from ..operators.joins import Joined, JoinedWindow

        return Joined("left", self, other) if isinstance(other, Stream) else JoinedWindow(self, other)

    def full_join(self, other: Stream) -> Any:
        from ..operators.joins import Joined

        return Joined("full", self, other)

    def left_inner_join(self, other: Stream) -> Any:
        from ..operators.joins import Joined

        return Joined("waiting", self, other)


class GroupedStream:
    """One stream for each key; ``key`` is the column of the innermost key."""

    def __init__(self, stream: Stream, key: str) -> None:
        self.stream, self.key = stream, key

    def key_binding(self) -> Binding:
        return _key_binding(self.key)

    def _inside(self) -> Stream:
        s = self.stream
        return Stream(s.df, s.columns, s.order, [*s.ctx, self.key], s.name, s.node_id)

    def select(self, fn: Callable[[Arg, Arg], Fields], emit: str = "running") -> Stream:
        """Aggregates of each group: one row at every record, or one in the end (``emit="final"``)."""
        from ..operators import grouped

        return grouped.select(self.stream, [*self.stream.ctx, self.key], self.key, fn(Arg("key"), Arg("r")), emit)

    def flat_map(self, fn: Callable[[Arg, Stream], Stream]) -> Stream:
        """``fn`` works on each group's stream; the results are merged and the key is dropped."""
        return _strip(fn(Key(self.key), self._inside()), self.stream.ctx)

    def map(self, fn: Callable[[Arg, Stream], Stream]) -> GroupedStream:
        """Like ``flat_map``, but the result stays grouped."""
        out = fn(Key(self.key), self._inside())
        df = out.df.select(*out.columns, *self.stream.ctx, self.key, *out.order)
        return GroupedStream(Stream(df, out.columns, out.order, self.stream.ctx, out.name, out.node_id), self.key)

    def record_window(self, n: int) -> RecordWindow:
        """The last ``n`` records of every group."""
        return RecordWindow(self, n)

    def tumbling_window(self, fn: Callable[[Arg], Expr], period: str, offset: str = "0 seconds") -> TimeWindowed:
        return TimeWindowed(self.stream, fn, period, period, offset, [self.key])

    def sliding_window(self, fn: Callable[[Arg], Expr], size: str, slide: str, offset: str = "0 seconds") -> TimeWindowed:
        return TimeWindowed(self.stream, fn, size, slide, offset, [self.key])

    def unique(self, value: Callable[[Arg], Any]) -> GroupedStream:
        """Of the records of a group with an equal value only the latest counts."""
        from ..operators import grouped

        return grouped.unique(self, value)


class Key(Arg):
    """A group's key inside the body of ``map`` or ``flat_map``."""

    def __init__(self, column: str) -> None:
        super().__init__("key")
        self._column = column

    def lower(self, env):  # noqa: ANN001, ANN201
        return F.col(self._column)

    def sides(self) -> set[str]:
        return set()

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__") or name in ("_arg", "_column"):
            raise AttributeError(name)
        return self.get(name)


class TimeWindowed:
    """Epoch-aligned windows of event time; functions get the window's start."""

    def __init__(self, stream: Stream, fn: Callable[[Arg], Expr], size: str, slide: str, offset: str, keys: list[str]) -> None:
        self.keys, self.size, self.slide = keys, size, slide
        self.column = f"_k{len(stream.ctx) + len(keys)}"
        time = stream.lower(fn)
        df = stream.df
        if stream.streaming:
            # the engine must know the event-time column itself
            df = df.withColumn("_t", time.cast("timestamp")).withWatermark("_t", size)
            time = F.col("_t")
        window = F.window(time, size, slide, offset) if size != slide else F.window(time, size, None, offset)
        self.stream = stream._with(df.withColumn("_w", window).withColumn(self.column, F.col("_w.start")), stream.columns)

    @property
    def _all_keys(self) -> list[str]:
        return [*self.stream.ctx, *self.keys, self.column]

    def select(self, fn: Callable[[Arg, Arg], Fields], emit: str = "running") -> Stream:
        from ..operators import grouped

        made = fn(Arg("key"), Arg("r"))
        if self.stream.streaming:
            return grouped.select_streaming_window(self, made)
        return grouped.select(self.stream, self._all_keys, self.column, made, emit)

    def flat_map(self, fn: Callable[[Arg, Stream], Stream]) -> Stream:
        s = self.stream
        inside = Stream(s.df, s.columns, s.order, self._all_keys, s.name, s.node_id)
        return _strip(fn(Key(self.column), inside), s.ctx)

    def apply(self, fn: Callable[[list[dict]], dict], schema: str) -> Stream:
        """``fn`` of the records of each whole window, in order: one row for each."""
        from ..operators import grouped

        return grouped.apply_whole(self.stream, self._all_keys, fn, schema)


class RecordWindow:
    def __init__(self, grouped: GroupedStream, n: int) -> None:
        if n < 1:
            raise ValueError("a record window holds one record at least")
        self.grouped, self.n = grouped, n

    def select(self, fn: Callable[[Arg], Fields]) -> Stream:
        """Aggregates over the last n records of all groups, after each record."""
        from ..operators import record_window

        return record_window.select(self, fn(Arg("r")))

    def apply(self, fn: Callable[[list[dict]], dict], schema: str) -> Stream:
        """Any function of those records."""
        from ..operators import record_window

        return record_window.apply(self, fn, schema)

    def flat_map(self, fn: Callable[[list[dict]], Iterable[dict]], schema: str) -> Stream:
        """Any number of records from those records, after each record."""
        from ..operators import record_window

        return record_window.flat_map(self, fn, schema)


def _key_binding(column: str) -> Binding:
    from pyspark.sql import types as T

    return Binding(lambda name: F.col(column).getField(name), T.StructType(), lambda: F.col(column))


def _strip(out: Stream, ctx: list[str]) -> Stream:
    return Stream(out.df.select(*out.columns, *ctx, *out.order), out.columns, out.order, ctx, out.name, out.node_id)
