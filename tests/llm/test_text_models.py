"""Classifiers by held-out accuracy, the language model by brute force."""

import math
from collections import Counter

import numpy as np

from pyspark.sql import functions as F
from rivulet.llm import brown, quality, toxicity
from rivulet.llm.common import held_out

SMALL = "/root/testdata/sf0.01"


def auc(rows):
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    return np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])


def scored(spark, query, column, sf):
    got = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", column), "doc_id").where("held_out").collect()
    return [(r["score"], r[column]) for r in got], [(r["predicted"], r[column]) for r in got]


def test_quality_on_held_out(spark):
    from rivulet.llm.queries import op10_quality

    scores, predicted = scored(spark, op10_quality, "quality", SMALL)
    assert auc(scores) > 0.97 and np.mean([p == y for p, y in predicted]) > 0.95


def test_toxicity_on_held_out(spark):
    from rivulet.llm.queries import op1_toxicity

    scores, predicted = scored(spark, op1_toxicity, "toxic", "/root/testdata/sf0.1")
    assert auc(scores) > 0.95 and np.mean([p == y for p, y in predicted]) > 0.95


def test_nnpu_separates_planted_words():
    rng = np.random.default_rng(0)
    noise = lambda: rng.choice(400, 20, replace=False).astype(np.int32)
    mark = lambda x: np.unique(np.r_[x, 500 + rng.integers(0, 5, 2)]).astype(np.int32)
    p = toxicity.ToxicityParams(hash_bits=10)
    pos = [mark(noise()) for _ in range(200)]
    unl = [mark(noise()) if rng.random() < 0.1 else noise() for _ in range(1000)]
    m = toxicity.fit_arrays(pos + unl, np.array([True] * 200 + [False] * 1000), 0.1, p)
    z = lambda x: m.intercept + m.weights[np.isin(m.features, x)].sum()
    assert min(z(mark(noise())) for _ in range(50)) > max(z(noise()) for _ in range(50))


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit_arrays(x, y, quality.QualityParams(rounds=20, pair_rounds=40))
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    assert {m.pairs[0][:2]} == {(0, 1)}
    # a score is the sum of the looked-up bins
    one = m.base + sum(t[np.searchsorted(c, v, side="right")] for c, t, v in zip(m.cuts, m.tables, x[0], strict=True))
    coarse = [np.searchsorted(c, v, side="right") for c, v in zip(m.pair_cuts, x[0], strict=True)]
    assert abs(one + sum(t[coarse[i], coarse[j]] for i, j, t in m.pairs) - m.logit(x[:1])[0]) < 1e-9


def test_classifiers_take_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int"
    )
    for fit, score, column in ((toxicity.fit, toxicity.score, "toxicity"), (quality.fit, quality.score, "quality_score")):
        model = fit(odd_docs.drop("toxic"), labels, ~held_out("doc_id", 4, 2))
        got = score(odd_docs, model)
        assert set(odd_docs.columns) < set(got.columns)
        values = [r[column] for r in got.collect()]
        assert len(values) == 11 and all(0 <= v <= 1 for v in values)
        model = fit(no_docs, labels.limit(0), F.lit(True))
        assert score(no_docs, model).count() == 0 and score(odd_docs, model).count() == 11


def test_base_and_counts_by_brute_force(spark, odd_docs, brute, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = docs.collect()
    table = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    tokens = lambda t: [*(t or "").encode().translate(table).split(), b""]
    out = lambda i: i is not None and brute.fold(i, 7) == 2
    counts = Counter()
    for i, t in rows:
        if not out(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), out(i), len(x), sum(counts[w] > 0 for w in x), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6))
        for i, t in rows for x in [tokens(t)]
    )
    got = brown.score(docs, held_out("doc_id", 7, 2), brown.BrownParams(held=500, exchanged=200, classes=16)).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert brown.score(no_docs, held_out("doc_id", 7, 2)).count() == 0


def test_model_is_a_distribution(spark):
    """Over all known words and one unknown word of every class, the next word's probabilities sum to one."""
    docs = spark.createDataFrame([(0, "a b a c b a"), (1, "b c d"), (3, "c a a d e")], "doc_id bigint, text string")
    p = brown.BrownParams(held=3, exchanged=2, classes=2, forms=4)
    probe = docs.unionByName(spark.createDataFrame([(50 + i, w) for i, w in enumerate("abcde")], docs.schema))
    got = {r["doc_id"]: r["score"] for r in brown.score(probe, F.col("doc_id") >= 50, p).collect()}
    assert all(-30 < got[50 + i] < 0 for i in range(5))


def test_exchange_finds_the_classes():
    rng = np.random.default_rng(4)
    kind = rng.integers(0, 3, 60)
    counts = Counter()
    at = 0
    for _ in range(20000):
        to = rng.choice(np.flatnonzero(kind == (kind[at] + 1) % 3))
        counts[at, to] += 1
        at = to
    a, b, n = (np.array(x) for x in zip(*((i, j, c) for (i, j), c in counts.items()), strict=True))
    of = brown.exchange((a, b, n), 60, 3, 20)
    assert all(len(set(of[kind == k])) == 1 for k in range(3)) and len(set(of)) == 3


def test_words_beyond_the_drivers_move_too(spark):
    """Words of one form, too rare for the driver, get classes by what stands beside them."""
    rng = np.random.default_rng(5)
    word = lambda kind: f"{kind * 40 + min(int(rng.exponential(8)), 39):03d}xx"
    text = lambda n: " ".join(word(i % 3) for i in range(n))
    p = brown.BrownParams(held=20, exchanged=12, classes=4, forms=4)
    right = " ".join(f"{k * 40 + j:03d}xx" for j in range(10, 16) for k in (0, 1, 2))
    wrong = " ".join(f"{k * 40 + j:03d}xx" for j in range(10, 16) for k in (2, 1, 0))
    rows = [*((i, text(60)) for i in range(300)), (1000, right), (1001, wrong)]
    got = brown.score(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") >= 1000, p)
    by = {r["doc_id"]: r["score"] for r in got.where("held_out").collect()}
    assert by[1000] > by[1001] + 3


def test_scores_do_not_depend_on_the_held_words(spark, odd_docs):
    """Words with a place in every worker and words that are joined are scored alike, neighbours too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    few, all_ = (
        sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5))
               for r in brown.score(docs, held_out("doc_id", 7, 2), brown.BrownParams(held=h, exchanged=200, classes=16)).collect())
        for h in (300, 1_000_000)
    )
    assert few == all_


def test_steps_are_a_distribution():
    rng = np.random.default_rng(6)
    p = brown.BrownParams(classes=3, forms=4)
    grid, kinds, once = rng.integers(0, 9, (8, 8)).astype(float), rng.integers(1, 9, 8), rng.integers(0, 3, (8, 4))
    next_ = 10 ** brown._steps(grid, kinds, once, p)
    assert np.allclose(next_[:, :8] @ (grid.sum(0) + p.alpha * kinds) + p.alpha * next_[:, 8:].sum(1), 1)
