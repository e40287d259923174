"""Enrichment joins: a record meets the latest record of the other side.

Both sides are put into one table with a side mark and ordered by (arrival,
side), the right side first at equal places.  One shuffle and one sort by the
key then give every pairing through window functions; there is no pairwise
join, so a key with very many records costs no more than its records.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import Arg, Binding, Expr, expr
from ..plans.conditions import Condition, split
from ..plans.stream import RecordWindow, Stream, TimeWindowed
from .running import from_next, up_to_now


class Joined:
    """``where`` and then ``select`` or ``select_all``."""

    def __init__(self, kind: str, left: Stream, right: Stream, condition: Condition | None = None) -> None:
        if len(left.order) != len(right.order):
            raise ValueError("the two streams are ordered in different ways")
        self.kind, self.left, self.right, self.condition = kind, left, right, condition

    def where(self, fn: Callable[[Arg, Arg], Expr]) -> Joined:
        return Joined(self.kind, self.left, self.right, split(fn(Arg("l"), Arg("r"))))

    def _env(self) -> dict[str, Binding]:
        def side(column: str, s: Stream) -> Binding:
            schema = s.df.select(*s.columns).schema
            return Binding(lambda name: F.col(column).getField(name), schema, lambda: F.col(column), lambda: F.col(column).isNotNull())

        return {"l": side("_l", self.left), "r": side("_r", self.right)}

    def _tagged(self) -> tuple[DataFrame, list[str], list[str]]:
        """Both sides in one table: (table, key columns, order columns)."""
        c, env = self.condition, self._env()
        if c is None:
            raise ValueError("a join needs where(...) first")
        order = self.left.order
        shared = [k for k in self.left.ctx if k in self.right.ctx]
        parts = []
        for mark, own, other, s, pre, pick in (
            (1, "_l", "_r", self.left, c.left, 0), (0, "_r", "_l", self.right, c.right, 1)
        ):
            df = s.df.select(F.struct(*s.columns).alias(own), *(F.col(k).alias(k) for k in shared), *order)
            if pre is not None:
                df = df.where(pre.lower(env))
            keys = [pair[pick].lower(env).alias(f"_j{i}") for i, pair in enumerate(c.keys)]
            empty = F.lit(None).cast(self._env()["r" if own == "_l" else "l"].schema).alias(other)
            parts.append(df.select(own, empty, *keys, *shared, *order, F.lit(mark).alias("_side")))
        table = parts[0].unionByName(parts[1])
        return table, [*shared, *(f"_j{i}" for i in range(len(c.keys)))], [*order, "_side"]

    def pairs(self) -> tuple[DataFrame, list[str], list[str]]:
        """(table with _l and _r, context columns, order columns) of every pair emitted."""
        if self.left.streaming or self.right.streaming:
            from ..streaming import lowering

            return lowering.join_pairs(self)
        table, keys, order = self._tagged()
        post = self.condition.post
        test = post.lower(self._env()) if post is not None else None
        ctx = [k for k in keys if k.startswith("_k")]
        now = up_to_now(keys, order)
        if self.kind == "left":
            out = table.withColumn("_r", F.last("_r", ignorenulls=True).over(now)).where("_side = 1")
        elif self.kind == "full":
            out = table.withColumn("_nl", F.last("_l", ignorenulls=True).over(now)).withColumn("_nr", F.last("_r", ignorenulls=True).over(now))
            out = out.drop("_l", "_r").withColumnsRenamed({"_nl": "_l", "_nr": "_r"})
        else:
            return self._waiting(table, keys, order, test, ctx)
        if test is not None:
            out = out.where(test)
        return out.select("_l", "_r", *ctx, *order), ctx, order

    def _waiting(self, table: DataFrame, keys: list[str], order: list[str], test: Column | None, ctx: list[str]) -> tuple[DataFrame, list[str], list[str]]:
        """Left records wait for the first right record that satisfies the condition."""
        at = F.struct(*order)
        table = table.withColumn("_at", at).withColumn("_ra", F.when(F.col("_side") == 0, F.struct("_r", "_at")))
        before = F.last("_ra", ignorenulls=True).over(up_to_now(keys, order))
        if test is None:
            after = F.first("_ra", ignorenulls=True).over(from_next(keys, order))
            out = table.withColumn("_m", F.coalesce(before, after)).where("_side = 1 AND _m IS NOT NULL")
        else:
            now = table.withColumn("_m", before).where("_side = 1")
            tried = now.withColumn("_r", F.col("_m._r")).withColumn("_good", F.coalesce(test & F.col("_m").isNotNull(), F.lit(False)))
            done = tried.where("_good").select("_l", "_m", *ctx, "_at")
            # the others take the first later right record that satisfies: least place over an equi-join
            wait = tried.where("NOT _good").select("_l", *keys, "_at")
            later = table.where("_side = 0").select(F.col("_r").alias("_r"), F.col("_at").alias("_ra2"), *(F.col(k).alias(f"{k}b") for k in keys))
            same = [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys]
            met = wait.join(later, same).where((F.col("_ra2") > F.col("_at")) & test)
            first = met.groupBy("_at").agg(
                F.first("_l").alias("_l"), F.min_by(F.struct(F.col("_r"), F.col("_ra2").alias("_at")), "_ra2").alias("_m"), *(F.first(k).alias(k) for k in ctx)
            )
            out = done.unionByName(first.select("_l", "_m", *ctx, "_at"))
        # a pair is emitted when its later half arrives; of several let go at once the earliest left comes first
        place = F.greatest(F.col("_at"), F.col("_m._at"))
        own = [F.col("_at").getField(c).alias(f"_p{i}") for i, c in enumerate(order)]
        out = out.select("_l", F.col("_m._r").alias("_r"), *ctx, *(place.getField(c).alias(c) for c in order), *own)
        return out, ctx, [*order, *(f"_p{i}" for i in range(len(order)))]

    def _stream(self, columns: list[Column], names: list[str]) -> Stream:
        df, ctx, order = self.pairs()
        fresh = [f"_o{i}" for i in range(len(order))]
        df = df.select(*columns, *ctx, *(F.col(c).alias(o) for c, o in zip(order, fresh, strict=True)))
        return Stream(df, names, fresh, ctx)

    def select(self, fn: Callable[[Arg, Arg], dict[str, Any]]) -> Stream:
        """Fields of both sides; either side may be missing."""
        made, env = fn(Arg("l"), Arg("r")), self._env()
        return self._stream([expr(v).lower(env).alias(k) for k, v in made.items()], list(made))

    def select_all(self) -> Stream:
        """All fields of both sides; a name of the right side that is taken gets the prefix right_."""
        names = list(self.left.columns)
        cols = [F.col("_l").getField(c).alias(c) for c in names]
        for c in self.right.columns:
            name = c if c not in names else f"right_{c}"
            base, n = name, 0
            while name in names:
                n += 1
                name = f"{base}{n}"
            names.append(name)
            cols.append(F.col("_r").getField(c).alias(name))
        return self._stream(cols, names)

    def lineage(self, left_id: str, right_id: str, left_name: str = "left", right_name: str = "right") -> DataFrame:
        """Which records each output came from: subject_id, sources array<struct<stream, record>>."""
        df, _, order = self.pairs()
        source = lambda side, column, name: F.when(
            F.col(side).isNotNull(), F.struct(F.lit(name).alias("stream"), F.col(side).getField(column).cast("string").alias("record"))
        )
        return df.select(
            F.concat_ws("-", *(F.col(c).cast("string") for c in order)).alias("subject_id"),
            F.filter(F.array(source("_l", left_id, left_name), source("_r", right_id, right_name)), lambda x: x.isNotNull()).alias("sources"),
        )


def _slices(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: the array of the places in the order where slices of about equal size begin, one for each shuffle partition."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select(*order).repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("b"))
    return dealt.agg(F.array_sort(F.collect_list("b")).alias("_starts"))


class JoinedWindow:
    """A stream with the whole contents of a window: ``apply(fn, schema)``."""

    def __init__(self, left: Stream, window: RecordWindow | TimeWindowed) -> None:
        self.left, self.window = left, window

    def apply(self, fn: Callable[[dict, list[dict]], dict], schema: str) -> Stream:
        """``fn`` of each left record and the records the window holds when it arrives.

        For a record window of the last n of every group.  The contents are
        built as arrays in the JVM: a right record is held from its arrival
        until the n-th record after it in its group.  The order is cut into
        slices, and a right record is put under every slice in which it is held,
        so the join is one on slices and meets hardly more than the contents.
        """
        import pandas as pd
        from pyspark.sql import types as T

        left, w = self.left, self.window
        if isinstance(w, TimeWindowed):
            raise NotImplementedError("give a record window: a stream has no event time of its own here")
        right, n, key = w.grouped.stream, w.n, w.grouped.key
        order = left.order
        names = T._parse_datatype_string(schema).names
        out = ", ".join([schema, *(f"{c} {left.df.schema[c].dataType.simpleString()}" for c in order)])
        # a right record leaves its window when the n-th record after it arrives
        mine = Window.partitionBy(*right.ctx, key).orderBy(*order)
        held = right.df.select(F.struct(*right.columns).alias("_r"), F.struct(*order).alias("_from"), F.lead(F.struct(*order), n).over(mine).alias("_until"))
        rows = left.df.select(F.struct(*left.columns).alias("_l"), *order, F.struct(*order).alias("_at"))
        starts = F.broadcast(_slices(left.df, order))  # one row
        slice_of = lambda c: F.size(F.filter("_starts", lambda b: b <= F.col(c)))
        rows = rows.crossJoin(starts).withColumn("_slice", slice_of("_at")).drop("_starts")
        last = F.when(F.col("_until").isNull(), F.size("_starts")).otherwise(slice_of("_until"))
        held = held.crossJoin(starts).withColumn("_slice", F.explode(F.sequence(slice_of("_from"), last))).drop("_starts")
        open_then = (F.col("_from") <= F.col("_at")) & (F.col("_until").isNull() | (F.col("_until") > F.col("_at")))
        met = rows.join(held.withColumnRenamed("_slice", "_in"), (F.col("_slice") == F.col("_in")) & open_then, "left")
        full = met.groupBy("_at").agg(F.first("_l").alias("_l"), F.array_sort(F.collect_list(F.when(F.col("_from").isNotNull(), F.struct("_from", "_r")))).alias("_rs"))
        full = full.select("_l", F.transform("_rs", lambda x: x["_r"]).alias("_rs"), *(F.col("_at").getField(c).alias(c) for c in order))

        def run(frames):  # noqa: ANN001, ANN202
            for pdf in frames:
                made = [fn(dict(r["_l"]), [dict(x) for x in r["_rs"]]) for r in pdf.to_dict("records")]
                yield pd.concat([pd.DataFrame(made, columns=names), pdf[order].reset_index(drop=True)], axis=1)

        return Stream(full.mapInPandas(run, out), list(names), order)
