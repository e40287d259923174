"""Shared helpers: work folders, row folds, connected components."""

from __future__ import annotations

import shutil
import tempfile
import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def _drop_own() -> None:
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_drop_own)


def work_base(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Taken from ``spark.checkpoint.dir``; only where that is unset (local
    sessions, tests) a folder of this process is made and used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="rivulet-"))
    return "file://" + _OWN[0]


#: Bytes of texts that go to a Python worker at once.
BATCH = "8m"
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH`` bytes, unless it has a bound of its own.

    Batches are held outside the heap, several times over while they grow, so
    with the default of 64 MB long texts take most of an executor's overhead.
    """
    if spark.conf.get(_BATCH_KEY, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, BATCH)


class Workspace:
    """Tables written under one fresh folder of the shared folder.

    ``keep`` cuts lineage: the rows are written once as Parquet by Spark's own
    commit protocol, so a lost executor costs a re-read and no recomputation.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark = spark
        self.root = f"{work_base(spark)}/{what}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def held_out(column: str, parts: int, which: int) -> Column:
    """True for the rows that nothing is learnt from; false for a null id."""
    return F.coalesce(fold(column, parts) == which, F.lit(False))


def least_hashed(rows: DataFrame, column: str, n: int, salt: str | int, distinct: bool = False) -> DataFrame:
    """The ``n`` rows with the least hashes of a column, the same at every layout of the rows.

    A large table is first cut at the hash that twice as many rows should be
    below, so what the one sorting task reads follows ``n`` and not the table.
    """
    order = F.xxhash64(F.lit(salt), column)
    total = rows.count()
    if total > 4 * n:
        some = rows.where(order < int((1 << 64) * (2 * n / total)) - (1 << 63))
        some = some.distinct() if distinct else some
        if some.count() >= n:  # else very many rows are repeated
            return some.orderBy(order, column).limit(n)
    return (rows.distinct() if distinct else rows).orderBy(order, column).limit(n)


def _only_stars(edges: DataFrame) -> bool:
    """True if every a has one edge and is no edge's b: then b, less than its a, is the least of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    found = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return found.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def connected_components(ws: Workspace, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges``: columns a, b (long).  Returns (node, root).  Alternating large
    and small stars: each round aggregates the least neighbour of a node with
    partial aggregation and joins it back, so a node with very many edges is
    never gathered in one place; the number of rounds grows with the logarithm
    of the longest chain, and edges that are stars already need none.  Each
    round is written to the shared folder and the round before it is deleted.
    """
    spark = ws.spark
    current = ws.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-0",
    )
    step = 0
    while not _only_stars(current):
        # large star: every neighbour above the node is moved to the least neighbour
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join below has an exchange on either side and a hot node's rows can be split
        least = ws.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least-{step}")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every neighbour below the node, and the node, go to the least
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            below.select("a", F.col("m").alias("b"))
        )
        step += 1
        following = ws.keep(small.where("a <> b").distinct(), f"{name}-{step}")
        ws.drop(f"{name}-{step - 1}")
        ws.drop(f"{name}-least-{step - 1}")
        current = following
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
