"""Vector best-fit packing of documents into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the
sum of the squared lengths of its pieces).  Documents longer than a sequence
are cut into full pieces and a rest; nothing else is cut.  Pieces are placed
from the longest to the shortest; each goes to the open sequence that fits it
under every capacity and is best by

* ``norm``: the smallest weighted norm of what would be left, or
* ``dot``: the largest weighted dot product of the piece with what is left.

A new sequence is opened only if none fits.

Pieces are dealt by a hash to groups of about ``group_sequences`` sequences
and each group is packed on its own, so the work and the memory of a task are
bounded at every size; a group leaves less than one sequence open, so at most
one sequence in ``group_sequences`` is lost by it.  Pieces that fill a
sequence need no search.

Defined results: a null text counts as empty and has the end id alone; rows
with equal or null ids are packed each for itself; an empty table packs to
nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .tokens import wide, word_ids


@dataclass(frozen=True)
class PackParams:
    tokens: int = 4096
    documents: int = 4096
    attention: float | None = None  # None: tokens squared, which no sequence can pass
    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02)
    group_sequences: int = 512


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end, step = word_ids(vocabulary), np.array([end_id], "<u4").tobytes(), size * 4
        for b in batches:
            texts, n = b.column(1).to_pylist(), []
            piece, start, length, crc = [], [], [], []
            for at in range(0, len(texts), 256):
                for ids in tool.many(texts[at : at + 256]):
                    ids, own = memoryview(wide(ids, tool.kind) + end), 0
                    for k, i in enumerate(range(0, len(ids), step)):
                        part = ids[i : i + step]
                        piece.append(k), start.append(i // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                        own += 1
                    n.append(own)
            keys = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: np.ndarray, p: PackParams = PackParams()) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece of one group."""
    attention = p.attention or float(p.tokens) ** 2
    if len(lengths) and (lengths.max() > p.tokens or float(lengths.max()) ** 2 > attention):
        raise ValueError("a piece is larger than a sequence")
    scale, weight = np.array([p.tokens, p.documents, attention], float), np.array(p.weights, float)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, ids, used = np.zeros((64, 3)), np.zeros(64, np.int64), 0  # open sequences
    n_bins = 0
    for at in np.lexsort((np.arange(len(lengths)), -lengths)):
        size = float(lengths[at])
        need = np.array([size, 1.0, size * size])
        rest = left[:used] - need
        fits = np.flatnonzero((rest >= 0).all(1))
        if len(fits):
            if p.rule == "norm":
                value = (weight * (rest[fits] / scale) ** 2).sum(1)
                k = int(fits[np.argmin(value)])
            else:
                value = (weight * (need / scale) * (left[fits] / scale)).sum(1)
                k = int(fits[np.argmax(value)])
        else:
            if used == len(ids):
                left, ids = np.concatenate([left, np.zeros_like(left)]), np.concatenate([ids, np.zeros_like(ids)])
            k = used
            left[k], ids[k] = scale, n_bins
            used, n_bins = used + 1, n_bins + 1
        bins[at], offsets[at] = ids[k], p.tokens - int(left[k, 0])
        left[k] -= need
        if (left[k] < 1).any():  # closed: no piece fits any more
            used -= 1
            left[k], ids[k] = left[used], ids[used]
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, p: PackParams = PackParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence_id and offset."""
    ws = Workspace(docs.sparkSession, "packing")
    size = p.tokens if p.attention is None else min(p.tokens, math.isqrt(int(p.attention)))
    cut = pieces(docs, vocabulary, end_id, size, key, text).withColumn("row", F.monotonically_increasing_id())
    cut = ws.keep(cut, "pieces")  # the row numbers are settled by this
    part = cut.where(F.col("length") < p.tokens)
    total = part.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (p.tokens * p.group_sequences)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable", ignore_index=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), p)
        # groups count by twos: even numbers are theirs, odd ones full pieces'
        pdf["sequence_id"], pdf["offset"] = ((bins * groups + pdf["grp"].to_numpy()) * 2), offsets
        return pdf[[*names, "sequence_id", "offset"]]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = part.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInPandas(run, schema)
    full = cut.where(F.col("length") >= p.tokens).select(
        *names, (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)
