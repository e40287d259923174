"""Nearest neighbours by inner product with a forest of random-projection trees.

Each tree cuts the space again and again by the median of a random projection,
down to leaves of about ``leaf`` rows.  All trees are searched through one
priority queue of branches ordered by how far the query is from their cuts,
until enough rows are in the leaves that have been opened; the rows of those
leaves are then ranked exactly.  Vectors are brought to one length first, by
one more coordinate that holds what is missing to the longest vector, so near
in angle means large in inner product.

How many rows are enough is measured: ``trials`` of the queries are compared
with every row, and the search opens as many rows as their true neighbours
needed for a recall of ``recall`` (``candidates`` at least).  So the recall
holds at every size and for every kind of data; how much of the table must be
opened for it is a property of the data.

The trees are fitted on at most ``sample`` vectors, down to leaves of no fewer
than ``least_leaf`` of them; every row is indexed.
Equal vectors are collapsed before indexing and put back in the ranking with
their smallest ids, more of which cannot be among the nearest.  The rows and
the queries of a leaf are dealt in blocks of at most ``block``, so no leaf
meets in one task however many rows it has.

Defined results: vectors that are null, empty, zero, of another length than
most, or hold null or non-finite components take no part; rows with equal id
count as one, with the least of their vectors; null ids take no part; ties go
to the smaller id; with fewer candidates than ``k`` all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, least_hashed


@dataclass(frozen=True)
class ForestParams:
    trees: int = 12
    sample: int = 65536
    leaf: int = 400
    least_leaf: int = 64
    candidates: int = 40000
    trials: int = 200
    recall: float = 0.96
    block: int = 4096
    k: int = 20
    seed: int = 42


@dataclass
class Tree:
    """Inner nodes: a row of ``planes``, a cut, children; a child below 0 is leaf -1 - child."""

    planes: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    leaves: int


def fit_tree(x: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    planes, cuts, children, leaves = [], [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            # the line between two of the rows, which follows where the data spread
            for _ in range(4):
                a, b = rng.choice(rows, 2, replace=False)
                plane = x[a] - x[b]
                size = np.linalg.norm(plane)
                if size == 0:
                    continue
                plane = plane / size
                side = x[rows] @ plane
                cut = float(np.median(side))
                low, high = rows[side <= cut], rows[side > cut]
                if len(low) and len(high):
                    me = len(cuts)
                    planes.append(plane), cuts.append(cut), children.append([0, 0])
                    children[me] = [grow(low), grow(high)]
                    return me
        leaves += 1
        return -leaves

    grow(np.arange(len(x)))
    d = x.shape[1]
    return Tree(np.array(planes).reshape(-1, d), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), leaves)


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of every row of x."""
    node = np.full(len(x), 0 if len(tree.cuts) else -1, np.int64)
    while (live := np.flatnonzero(node >= 0)).size:
        at = node[live]
        side = np.einsum("ij,ij->i", x[live], tree.planes[at]) > tree.cuts[at]
        node[live] = tree.children[at, side.astype(np.int64)]
    return -1 - node


def visit(forest: list[Tree], counts: list[np.ndarray], q: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(tree, leaf, rows opened before it) in the order of one priority queue over all trees."""
    margins = [t.planes @ q - t.cuts for t in forest]
    queue = [(0.0, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    rows = 0
    while queue:
        cost, t, node = heapq.heappop(queue)
        children, margin = forest[t].children, margins[t]
        while node >= 0:
            m = margin[node]
            near = 1 if m > 0 else 0
            heapq.heappush(queue, (max(cost, abs(m)), t, int(children[node, 1 - near])))
            node = int(children[node, near])
        leaf = -1 - node
        yield t, leaf, rows
        rows += int(counts[t][leaf])


def _unit(x: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate, so that every row has the length of the longest."""
    more = np.sqrt(np.maximum(longest * longest - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, more[:, None]], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): one row for each id, with a finite vector that is not zero."""
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda c: c != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _true_neighbours(placed: DataFrame, trials: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """trial, leaf: the leaves of the ``k`` nearest rows of every trial, over all rows.

    Each task keeps its own nearest few of every trial, so what is brought
    together is bounded by the trials and the number of tasks.
    """
    shared = placed.sparkSession.sparkContext.broadcast((np.array([q for q, _ in trials]), np.array([w for _, w in trials])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, w = shared.value
        best: list[list[tuple[float, int, bytes]]] = [[] for _ in w]
        for b in batches:
            if not b.num_rows:
                continue
            v, ids, leaves = _matrix(b.column(1)), b.column(0).to_numpy(), _matrix(b.column(2)).astype("<i4")
            s = w @ v.T
            for n, row in enumerate(s):
                top = np.argpartition(-row, k)[: k + 1] if len(row) > k + 1 else np.arange(len(row))
                best[n] = sorted(best[n] + [(-float(row[i]), int(ids[i]), leaves[i].tobytes()) for i in top])[: k + 1]
        rows = [(n, -s, i, x) for n, own in enumerate(best) for s, i, x in own]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.float64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["trial", "score", "rep", "leaf"])

    near = placed.mapInArrow(run, "trial int, score double, rep long, leaf binary")
    place = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "rep"))
    return near.withColumn("n", place).where(F.col("n") <= k + 1).select("trial", "rep", "leaf")


def rows_to_open(
    forest: list[Tree], counts: list[np.ndarray], trials: list[np.ndarray], leaves: list[list[np.ndarray]], recall: float
) -> int:
    """The least number of rows after which a share ``recall`` of the trials' neighbours has been met."""
    needed = []
    for q, own in zip(trials, leaves, strict=True):
        open_at = [set(enumerate(x.tolist())) for x in own]
        for t, leaf, before in visit(forest, counts, q):
            met = [x for x in open_at if (t, leaf) in x]
            if met:
                needed += [before + 1] * len(met)
                open_at = [x for x in open_at if (t, leaf) not in x]
            if not open_at:
                break
    needed.sort()
    return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else 0


def search(
    vectors: DataFrame, is_query: Column, p: ForestParams = ForestParams(), key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest of each query.

    ``is_query``: a condition on the column id.
    """
    spark = vectors.sparkSession
    ws, empty = Workspace(spark, "forest"), "query_id long, rank int, vec_id long, score double"
    rows = ws.keep(usable(vectors, key, vector), "rows")
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == width["n"])
    # equal vectors: one representative, with as many ids as a ranking can show
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= p.k + 1)
    reps = ws.keep(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "reps")
    sample = least_hashed(reps, "rep", p.sample, p.seed).select("v").toArrow().column(0).combine_chunks()
    longest, n_reps = reps.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))), F.count("*")).first()
    x = _unit(_matrix(sample), longest)
    rng = np.random.default_rng(p.seed)
    forest = [fit_tree(x, max(p.least_leaf, p.leaf * len(x) // n_reps), rng) for _ in range(p.trees)]
    shared = spark.sparkContext.broadcast((forest, longest))  # bounded by sample and trees

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, top = shared.value
        for b in batches:
            u = _unit(_matrix(b.column(1)), top)
            leaf = np.stack([assign(t, u) for t in trees], axis=1) if len(u) else np.zeros((0, len(trees)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(leaf.astype(np.int32)), pa.list_(pa.int32()))], ["rep", "v", "leaf"]
            )

    placed = ws.keep(reps.select("rep", "v").mapInArrow(index, "rep long, v array<double>, leaf array<int>"), "placed")
    sizes = [np.zeros(t.leaves, np.int64) for t in forest]
    for r in placed.select(F.posexplode("leaf").alias("t", "leaf")).groupBy("t", "leaf").count().collect():
        sizes[r[0]][r[1]] = r[2]  # one number for each leaf of the fitted trees
    held = spark.sparkContext.broadcast(sizes)
    queries = rows.where(is_query)
    trials = [(r[0], r[1]) for r in least_hashed(queries.select("id", "v"), "id", p.trials, p.seed).collect()]
    if not trials:
        return spark.createDataFrame([], empty)
    true = [[] for _ in trials]
    for r in _true_neighbours(placed, trials, p.k).collect():
        if r["rep"] != trials[r["trial"]][0]:
            true[r["trial"]].append(np.frombuffer(r["leaf"], "<i4"))
    flat = [np.r_[np.array(w), 0.0] for _, w in trials]
    budget = max(p.candidates, rows_to_open(forest, sizes, flat, true, p.recall))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (trees, top), counts = shared.value, held.value
        for b in batches:
            u = _unit(_matrix(b.column(1)), top)
            # the query itself has no missing part: the extra coordinate is 0
            u[:, -1] = 0
            way = [[(t, leaf) for t, leaf, _ in takewhile(lambda x: x[2] < budget, visit(trees, counts, q))] for q in u]
            n = [len(w) for w in way]
            at = pa.array(np.repeat(np.arange(b.num_rows), n))
            flat = np.array([x for w in way for x in w], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["query_id", "t", "leaf"]
            )

    visits = ws.keep(queries.mapInArrow(route, "query_id long, t int, leaf int"), "visits")
    traffic = {(r[0], r[1]): r[2] for r in visits.groupBy("t", "leaf").count().collect()}
    blocks = [
        (t, leaf, max(1, -(-int(n) // p.block)), max(1, -(-traffic.get((t, leaf), 0) // p.block)))
        for t, s in enumerate(sizes) for leaf, n in enumerate(s) if n and (t, leaf) in traffic
    ]
    if not blocks:
        return spark.createDataFrame([], empty)
    plan = spark.createDataFrame(blocks, "t int, leaf int, rb int, qb int")  # one row for each leaf
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        placed.select("rep", "v", F.posexplode("leaf").alias("t", "leaf")).join(F.broadcast(plan), ["t", "leaf"])
        .select("rep", "v", "t", "leaf", F.pmod(F.xxhash64("rep"), F.col("rb")).cast("int").alias("r"), spread("qb").alias("q"))
    )
    right = (
        visits.join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("w")), "query_id").join(F.broadcast(plan), ["t", "leaf"])
        .select("query_id", "w", "t", "leaf", F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int").alias("q"), spread("rb").alias("r"))
    )
    k = p.k

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"query_id": [], "rep": [], "score": []})
        v, w = np.stack(a["v"].to_numpy()), np.stack(b["w"].to_numpy())
        ids, take = a["rep"].to_numpy(), min(k + 2, len(a))
        out = []
        for at in range(0, len(w), 256):
            s = w[at : at + 256] @ v.T
            if take < len(a):
                # whatever reaches the k+2nd score, with room for the last bits
                edge = np.partition(s, len(a) - take, axis=1)[:, len(a) - take] - 1e-9
                q, c = np.nonzero(s >= edge[:, None])
            else:
                q, c = (z.ravel() for z in np.indices(s.shape))
            score = np.zeros(len(q))  # added in the order of the components, so the last bit is the same everywhere
            for x, y in zip(w[at + q].T, v[c].T, strict=True):
                score += x * y
            out.append(pd.DataFrame({"query_id": b["query_id"].to_numpy()[at + q], "rep": ids[c], "score": score}))
        return pd.concat(out)

    keys = ["t", "leaf", "r", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "query_id long, rep long, score double")
    best = found.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k + 1)
    each = top.join(reps.select("rep", "ids"), "rep").select("query_id", "score", F.explode("ids").alias("vec_id"))
    each = each.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return each.select("query_id", "rank", "vec_id", "score")
