"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are reduced to lower-case words with one space between.  An
item of m characters is found in a document if some stretch of the document is
within k = floor(rate * m) edits of it.  Of k + 1 pieces of the item one at
least is then whole in the document, so pieces are searched exactly (one
Aho-Corasick automaton over all pieces), and around the hits Myers' bit-parallel
distance decides.  Stretches around the hits of one item are merged first, so
no character is verified more often than once for an item.

The items are taken in blocks of bounded size; each block is one pass over the
documents, so a larger benchmark costs more passes and no more memory.

Defined results: null or wordless documents and items match nothing; repeated
rows of either table give each its own rows; null ids are carried as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"\w+")
#: Characters of items in one block, which every worker holds.
BLOCK = 4_000_000
_SCHEMA = "doc_id long, item_id long, distance int, budget int, end long"


def normal(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 runs of nearly equal length that make up the item: (start, run)."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


class Myers:
    """Least edit distance of a pattern to any stretch of a text."""

    def __init__(self, pattern: str) -> None:
        self.m, self.peq = len(pattern), {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the first best stretch; the empty one counts."""
        m, peq = self.m, self.peq
        full, high = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best, end = full, 0, m, m, 0
        for i, c in enumerate(text, 1):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & full)
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv = mh | (~(xv | ph) & full)
            mv = ph & xv
            if score < best:
                best, end = score, i
        return best, end


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float) -> None:
        import ahocorasick

        self.items, self.budgets = items, [budget(t, rate) for _, t in items]
        self.tools: dict[int, Myers] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for n, ((_, text), k) in enumerate(zip(items, self.budgets, strict=True)):
            for start, run in pieces(text, k):
                where.setdefault(run, []).append((n, start))
        self.automaton = ahocorasick.Automaton()
        for run, places in where.items():
            self.automaton.add_word(run, (len(run), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, budget, end) of the best match of each item that matches."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, start in places:
                k, at = self.budgets[n], last + 1 - size - start
                spans.setdefault(n, []).append((max(0, at - k), min(len(text), at + len(self.items[n][1]) + k)))
        out = []
        for n, runs in spans.items():
            k, best = self.budgets[n], None
            runs.sort()
            merged = [list(runs[0])]
            for a, b in runs[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                if k == 0:
                    got = (0, text.index(self.items[n][1], a) + len(self.items[n][1]))
                else:
                    if n not in self.tools:
                        self.tools[n] = Myers(self.items[n][1])
                    d, end = self.tools[n].best(text[a:b])
                    got = (d, a + end)
                if got[0] <= k and (best is None or got < best):
                    best = got
            if best:
                out.append((self.items[n][0], best[0], k, best[1]))
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        text = normal(r[1])
        if text:
            if block and size + len(text) > BLOCK:
                yield block
                block, size = [], 0
            block.append((r[0], text))
            size += len(text)
    if block:
        yield block


def _pass(docs: DataFrame, block: list[tuple[int | None, str]], rate: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((block, rate))  # at most BLOCK characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*shared.value)
        for b in batches:
            rows = [
                (i, *hit) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in matcher.find(normal(t))
            ]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "budget", "end"]
            )

    return docs.mapInArrow(run, _SCHEMA)


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.05, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item that match: doc_id, item_id, distance, budget, end.

    ``items``: item_id, text.  ``end`` counts in the normalised document.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = [_pass(rows, b, rate) for b in _blocks(items.select(F.col("item_id").cast("long"), "text"))]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _SCHEMA)
