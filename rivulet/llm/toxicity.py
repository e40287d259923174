"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, taken
without regard to labels, is the unlabelled set.  A logistic classifier on the
shares that words have of a text minimises the class-prior-corrected risk

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

in numpy; where the bracket falls below ``-beta`` the step climbs back instead
(weight ``gamma``).  The class prior ``pi`` is measured over all labelled
training rows unless it is given.

A word counts in full from one word in ``full`` on and in proportion below, so
that a long text is not judged by a word or two that stand in it by chance.

Bounds: at most ``max_positive`` + ``max_unlabelled`` documents are fitted, in
the order of a hash of their ids, so the choice is the same at every size of
the cluster.  Scores are computed over whole texts.

Defined results: a null or empty text scores by the intercept alone; rows with
equal ids are each scored; a document with a null id is scored and never learnt
from; if no positive can be learnt from, every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed

_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityParams:
    hash_bits: int = 20
    max_positive: int = 4000
    max_unlabelled: int = 8000
    max_features: int = 512
    min_positives: int = 4
    min_z: float = 5.0
    full: float = 30.0
    prior: float | None = None
    beta: float = 0.0
    gamma: float = 1.0
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # sorted word hashes
    weights: np.ndarray
    intercept: float
    prior: float


#: Words whose hashes or places a worker remembers; emptied when full.
_MEMORY = 200_000


def word_hashes(word: str, bits: int) -> list[int]:
    """The hashes of a lower-case word and of its first four, five and six letters."""
    forms = [word, *("^" + word[:k] for k in (4, 5, 6) if len(word) > k)]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for f in forms]


def features(text: str | None, p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words of a whole text and of their beginnings, and how much each counts (0 to 1)."""
    counts: Counter = Counter()
    words = Counter(_WORD.findall((text or "").lower()))
    for w, n in words.items():
        for h in word_hashes(w, p.hash_bits):
            counts[h] += n
    keys = np.array(sorted(counts), np.int32)
    times = np.array([counts[k] for k in keys.tolist()], float)
    return keys, np.minimum(1, p.full * times / max(words.total(), 1))


def fit_arrays(
    rows: list[np.ndarray], positive: np.ndarray, prior: float, p: ToxicityParams, values: list[np.ndarray] | None = None
) -> ToxicityModel:
    """The non-negative risk over hashed words; ``positive`` marks P, the others are U.

    ``values``: how much each word of a row counts; without them each counts in full.
    """
    size = 1 << p.hash_bits
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    df_p, df_u = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row, sign in zip(rows, positive, strict=True):
        (df_p if sign else df_u)[row] += 1  # a row has each hash once
    share_p, share_u = (df_p + 0.5) / (n_p + 1), (df_u + 0.5) / (n_u + 1)
    pooled = (df_p + df_u + 1) / (n_p + n_u + 2)
    gain = (share_p - share_u) / np.sqrt(pooled * (1 - pooled) * (1 / (n_p + 1) + 1 / (n_u + 1)))
    gain[(df_p < p.min_positives) | (gain < p.min_z)] = 0
    chosen = np.sort(np.argsort(-gain, kind="stable")[: p.max_features])
    chosen = chosen[gain[chosen] > 0].astype(np.int64)
    column = np.full(size, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    # only the chosen words of a row are held, so memory follows them
    places = [np.flatnonzero(column[row] >= 0) for row in rows]
    r_ix = np.repeat(np.arange(len(rows)), [len(x) for x in places])
    c_ix = np.concatenate([column[row[x]] for row, x in zip(rows, places, strict=True)] or [np.zeros(0, np.int64)])
    v_ix = np.concatenate([v[x] for v, x in zip(values, places, strict=True)]).astype(float) if values else np.ones(len(c_ix))
    w, b = np.zeros(len(chosen)), -1.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, p.steps + 1):
        z = b + np.bincount(r_ix, w[c_ix] * v_ix, len(rows))
        s = sigmoid(z)
        # logistic loss: as positive log(1 + e^-z), as negative log(1 + e^z)
        negative = np.logaddexp(0, z)
        bracket = negative[~positive].mean() - prior * negative[positive].mean()
        up, down = np.zeros(len(rows)), np.zeros(len(rows))
        up[positive] = prior * (s[positive] - 1) / n_p
        down[~positive] = s[~positive] / n_u
        down[positive] = -prior * s[positive] / n_p
        g = up + down if bracket >= -p.beta else -p.gamma * down
        grad = np.append(np.bincount(c_ix, g[r_ix] * v_ix, len(chosen)) + p.decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return ToxicityModel(chosen, w, float(b), prior)


class Scorer:
    """Scores texts; remembers which features of the model a word has."""

    def __init__(self, model: ToxicityModel, p: ToxicityParams) -> None:
        self.p, self.intercept, self.weights = p, model.intercept, model.weights.tolist()
        self.place = {int(f): k for k, f in enumerate(model.features)}
        self.memo: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> float:
        words, memo, times = Counter(_WORD.findall((text or "").lower())), self.memo, {}
        for w, n in words.items():
            places = memo.get(w)
            if places is None:
                if len(memo) > _MEMORY:
                    memo.clear()
                places = memo[w] = [self.place[h] for h in word_hashes(w, self.p.hash_bits) if h in self.place]
            for k in places:
                times[k] = times.get(k, 0) + n
        scale = self.p.full / max(words.total(), 1)
        z = self.intercept + sum(self.weights[k] * min(1.0, scale * times[k]) for k in sorted(times))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, params: ToxicityParams = ToxicityParams()) -> ToxicityModel | None:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``usable`` is a condition on doc_id."""
    p = params
    marked = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    by_hash = lambda df, n: [r[0] for r in least_hashed(df, "doc_id", n, "sample", distinct=True).collect()]
    known = set(by_hash(marked.where("toxic = 1").select("doc_id"), p.max_positive))
    if not known:
        return None
    prior = p.prior
    if prior is None:
        prior = marked.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = min(max(prior, 1e-4), 0.9)
    blind = set(by_hash(docs.where(usable & F.col("doc_id").isNotNull()).select("doc_id"), p.max_unlabelled))
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i, i in known, i in blind) for i in sorted(known | blind)], "doc_id long, p boolean, u boolean")
    # at most max_positive + max_unlabelled ids; one text for each id
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id", "p", "u").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t, p) for t in b.column(3).to_pylist()]
            hashes = pa.array([h.astype("<i4").tobytes() for h, _ in got], pa.binary())
            weights = pa.array([v.astype("<f2").tobytes() for _, v in got], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], hashes, weights], ["doc_id", "p", "u", "h", "v"])

    made = texts.select("doc_id", "p", "u", "text").mapInArrow(run, "doc_id long, p boolean, u boolean, h binary, v binary")
    rows, values, positive = [], [], []
    for _, in_p, in_u, h, v in sorted(made.collect()):
        for member, sign in ((in_p, True), (in_u, False)):
            if member:
                rows.append(np.frombuffer(h, "<i4"))
                values.append(np.frombuffer(v, "<f2"))
                positive.append(sign)
    return fit_arrays(rows, np.array(positive), prior, p, values) if any(positive) and not all(positive) else None


def score(docs: DataFrame, model: ToxicityModel | None, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """``docs`` with a column toxicity (double, 0 to 1) added."""
    if model is None:
        return docs.withColumn("toxicity", F.lit(0.0))

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model, params)
        for texts in batches:
            yield texts.map(scorer).astype("float64")

    return docs.withColumn("toxicity", toxicity(F.coalesce("text", F.lit(""))))
