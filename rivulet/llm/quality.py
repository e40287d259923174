"""Text quality by a generalised additive model with pairwise interactions.

Numeric features of the whole text are cut into quantile bins.  Boosting goes
round the features again and again; each turn fits a tree of depth two to the
logistic gradient over the bins of one feature and adds it to that feature's
lookup table.  The pairs of features that lower the remaining loss most then
get two-way tables, boosted in the same way with one cut on either axis.  A
score is the sum of the looked-up bins, so it is a few vectorised additions.

Bounds: at most ``max_rows`` labelled documents are fitted, in the order of a
hash of their ids.  Defined results: a null text counts as empty and is scored
like any other; rows with equal ids are each scored; null ids and null labels
are never learnt from; without both classes the score is the known share of
class 1, or 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashed

FEATURES = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper", "digit", "symbol", "comma", "stop", "bang",
    "pipe", "non_ascii", "lines", "words_per_line", "repeated_lines", "distinct_words", "top_word", "short_words",
    "compression", "caps_words", "repeated_pairs", "wordlike",
)

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_ALNUM_SPACE = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(9, 14), 32, *range(128, 256)])
_CHUNK = 1 << 16


def text_features(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for one whole text; all 0 for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, k = max(len(words), 1), max(len(lines), 1)
    kinds, each_line = Counter(words), Counter(lines)
    lengths = [len(x) for x in words] or [0]
    without = lambda drop: n - len(raw.translate(None, drop))
    squeeze = zlib.compressobj(1)
    small = sum(len(squeeze.compress(raw[i : i + _CHUNK])) for i in range(0, n, _CHUNK)) + len(squeeze.flush())
    pairs = Counter(zip(words, words[1:], strict=False))
    symbols = n - without(_ALNUM_SPACE)
    return [
        np.log1p(n), np.log1p(len(words)), sum(lengths) / w, np.log1p(max(lengths)), without(_UPPER) / n,
        without(_DIGIT) / n, symbols / n, raw.count(b",") / w, raw.count(b".") / w, raw.count(b"!") / w,
        raw.count(b"|") / w, without(bytes(range(128, 256))) / n, np.log1p(len(lines)), np.log1p(len(words) / k),
        1 - len(each_line) / k, len(kinds) / w, max(kinds.values(), default=0) / w, sum(x <= 3 for x in lengths) / w,
        small / n, sum(1 for x in words if x.isupper() and len(x) > 1) / w, 1 - len(pairs) / max(len(words) - 1, 1),
        sum(1 for x in words if x.isalpha()) / w,
    ]


@dataclass(frozen=True)
class QualityParams:
    max_rows: int = 20000
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 120
    pair_rounds: int = 60
    pairs: int = 8
    rate: float = 0.15
    min_rows: int = 8
    ridge: float = 1.0


@dataclass
class QualityModel:
    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, j], side="right")]
        coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.pair_cuts)]
        for i, j, table in self.pairs:
            z += table[coarse[i], coarse[j]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: QualityParams) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl, nl = (np.cumsum(a)[:-1] for a in (g, h, n))
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    gain = gl**2 / (hl + p.ridge) + (gt - gl) ** 2 / (ht - hl + p.ridge) - gt**2 / (ht + p.ridge)
    gain[(nl < p.min_rows) | (nt - nl < p.min_rows)] = 0
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: QualityParams, depth: int = 2) -> np.ndarray:
    """Values by bin of a tree over ordered bins, from gradient and curvature sums."""
    _, k = _best_cut(g, h, n, p) if depth else (0, 0)
    if not k:
        return np.full(len(g), -g.sum() / (h.sum() + p.ridge))
    return np.concatenate([_tree(g[:k], h[:k], n[:k], p, depth - 1), _tree(g[k:], h[k:], n[k:], p, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: QualityParams) -> tuple[float, np.ndarray]:
    """One cut on either axis, then the best cut on the other for each half: (gain, table)."""
    best = (0.0, np.zeros(g.shape))
    for axis in (0, 1):
        a, b, c = (x if axis == 0 else x.T for x in (g, h, n))
        for k in range(1, a.shape[0]):
            out, gain = np.zeros(a.shape), -(a.sum() ** 2) / (b.sum() + p.ridge)
            for part in (slice(0, k), slice(k, None)):
                u, v, w = a[part].sum(0), b[part].sum(0), c[part].sum(0)
                more, cut = _best_cut(u, v, w, p)
                gain += more + u.sum() ** 2 / (v.sum() + p.ridge)
                for cols in (slice(0, cut), slice(cut, None)):
                    if len(u[cols]):
                        out[part, cols] = -u[cols].sum() / (v[cols].sum() + p.ridge)
            if gain > best[0]:
                best = (float(gain), out if axis == 0 else out.T)
    return best


def fit_arrays(x: np.ndarray, y: np.ndarray, p: QualityParams = QualityParams()) -> QualityModel:
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = QualityModel(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [_cuts(x[:, j], p.bins) for j in range(x.shape[1])]
    fine = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(y), model.base)
    state = lambda: (s := 1 / (1 + np.exp(-np.clip(z, -40, 40))), s - y, s * (1 - s))[1:]
    for _ in range(p.rounds):
        for j, ix in enumerate(fine):
            g, h = state()
            size = len(model.tables[j])
            step = p.rate * _tree(np.bincount(ix, g, size), np.bincount(ix, h, size), np.bincount(ix, minlength=size), p)
            model.tables[j] += step
            z += step[ix]
    model.pair_cuts = [_cuts(x[:, j], p.pair_bins) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        ix, shape = coarse[i] * sizes[j] + coarse[j], (sizes[i], sizes[j])
        n = shape[0] * shape[1]
        return _pair_tree(*(np.bincount(ix, q, n).reshape(shape) for q in (g, h, np.ones(len(y)))), p)

    g, h = state()
    ranked = sorted(((-grid(i, j)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))[: p.pairs]
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for gain, i, j in ranked if gain < 0]
    for _ in range(p.pair_rounds):
        for i, j, table in model.pairs:
            g, h = state()
            step = p.rate * grid(i, j)[1]
            table += step
            z += step[coarse[i], coarse[j]]
    return model


def _featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, params: QualityParams = QualityParams()) -> QualityModel:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); ``usable`` is a condition on doc_id."""
    marked = labels.where(usable & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    sample = least_hashed(marked, "doc_id", params.max_rows, "sample").collect()
    ids = docs.sparkSession.createDataFrame([(r[0], int(r[1])) for r in sample], "doc_id long, y int")
    # at most max_rows ids; one text for each id
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    rows = sorted((r[0], r[1], r[2]) for r in _featured(texts).join(F.broadcast(ids), "doc_id").select("doc_id", "y", "x").collect())
    x = np.array([r[2] for r in rows]).reshape(-1, len(FEATURES))
    return fit_arrays(x, np.array([r[1] for r in rows], float), params)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with a column quality_score (double, 0 to 1) added."""

    @F.pandas_udf("double")
    def quality(texts):  # noqa: ANN001, ANN202
        x = np.array([text_features(t) for t in texts]).reshape(-1, len(FEATURES))
        return texts.map(lambda _: 0.0).astype("float64") * 0 + model.score(x)

    return docs.withColumn("quality_score", quality(F.coalesce("text", F.lit(""))))
