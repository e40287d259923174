import numpy as np
from pyspark.sql import functions as F
from rivulet.llm import ann

SF = "/root/testdata/sf0.1"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:k]
        out[q] = [ids[i] for i in order]
    return out


def test_recall_and_scores(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"]).astype(float)
    p = ann.ForestParams(trees=8, leaf=40, candidates=1)  # the rows to open are measured
    got = ann.search(spark.read.parquet(f"{SF}/embeddings.parquet"), F.col("id") % 20 == 0, p).toPandas()
    want = brute(ids, x, ids[ids % 20 == 0], 20)
    hits = sum(len(set(g["vec_id"]) & set(want[q])) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) > 0.9
    at = {v: i for i, v in enumerate(ids)}
    exact = np.array([x[at[q]] @ x[at[v]] for q, v in zip(got["query_id"], got["vec_id"], strict=True)])
    assert np.abs(exact - got["score"]).max() < 1e-12
    for _, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and (np.diff(g["score"]) <= 0).all()


def test_ties_copies_and_blocks(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8)) * rng.uniform(0.5, 3, (60, 1))
    x = np.concatenate([base, np.repeat(base[:1], 80, axis=0)])  # one vector very often
    ids = rng.permutation(len(x)) * 3
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows + rows[:5], "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS rep", "2 AS v")
    p = ann.ForestParams(trees=3, leaf=8, candidates=10_000, block=4)
    got = ann.search(df, F.col("id") % 2 == 0, p).toPandas().sort_values(["query_id", "rank"])
    want = brute(ids, x, ids[ids % 2 == 0], 20)
    assert {q: list(g["vec_id"]) for q, g in got.groupby("query_id")} == want


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in ann.search(df, F.col("id") % 2 == 0).collect()]
    assert got == [(0, 1, 1, 0.5)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0 and ann.search(df, F.lit(False)).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_tree_assignment_follows_its_cuts():
    x = np.random.default_rng(1).normal(size=(500, 5))
    t = ann.fit_tree(x, 20, np.random.default_rng(2))
    leaves = ann.assign(t, x)
    assert leaves.min() >= 0 and leaves.max() < t.leaves and np.bincount(leaves).max() <= 20
    counts = [np.bincount(leaves, minlength=t.leaves)]
    every = list(ann.visit([t], counts, x[0]))
    assert sorted(e[:2] for e in every) == [(0, k) for k in range(t.leaves)] and every[0] == (0, leaves[0], 0)
    assert [e[2] for e in every] == np.cumsum([0] + [counts[0][k] for _, k, _ in every])[:-1].tolist()


def test_rows_to_open_reach_the_recall():
    """Neighbours in the leaf opened n-th are met once more rows may be opened than are in the leaves before it."""
    x = np.random.default_rng(1).normal(size=(500, 5))
    t = ann.fit_tree(x, 20, np.random.default_rng(2))
    counts = [np.bincount(ann.assign(t, x), minlength=t.leaves)]
    way = list(ann.visit([t], counts, x[0]))
    near = [np.array([leaf]) for _, leaf, _ in way[:10]]
    for n in (1, 5, 9):
        assert ann.rows_to_open([t], counts, [x[0]], [near], n / 10 - 0.05) == way[n - 1][2] + 1
    assert ann.rows_to_open([t], counts, [x[0]], [[]], 0.9) == 0
