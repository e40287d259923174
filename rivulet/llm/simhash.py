"""SimHash near-duplicate classes by pigeonhole blocks.

A text is a 64-bit fingerprint: a bit is set if it is set in over half of the
hashes (XXH64, seed 42) of its word shingles, repeats counted.  Fingerprints
link at ``radius`` or fewer differing bits.  The 64 bits are cut into
``radius + 2`` blocks; two fingerprints that differ in ``radius`` bits agree
on two whole blocks at least, so a join on each pair of blocks finds all
links, and the Hamming distance is then verified.

Equal fingerprints are collapsed before the search, so copies never meet in
pairs.  A pair of blocks that very many different fingerprints share is
searched in another exact way that grows in proportion to their number; see
``_dense_links``.

``near_classes`` is the wider search for texts that share most of their
five-word shingles (a similarity of 0.8 or more), which differ in too many bits
of one 64-bit fingerprint for whole blocks to be left: it looks for candidates
by pairs of blocks of four fingerprints of the words, and verifies the Hamming
distance of 256-bit fingerprints of the shingles.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and links like any other; rows with equal doc_id are rows of
their own with one component; a null doc_id has a fingerprint and takes part,
its component is the smallest known id of its class (null if there is none).
Columns besides the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, connected_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles hashed at once, so that a very long text needs bounded memory.
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    width = min(words, len(tokens))
    total, ones = len(tokens) - width + 1, np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, _CHUNK):
        part = tokens[at : min(at + _CHUNK, total) + width - 1]
        hashes = np.fromiter(
            (digest(join(s), 42) for s in zip(*(part[k:] for k in range(width)), strict=False)),
            np.uint64,
            len(part) - width + 1,
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = ones * 2 > total
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; fp holds the 64 bits, signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _blocks(radius: int) -> list[int]:
    """A mask of its bits for each pair of the ``radius + 2`` blocks."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(n)]
    return [masks[i] | masks[j] for i, j in combinations(range(n), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, radius: int) -> DataFrame:
    """(t, block, fp): each fingerprint under each pair of blocks."""
    entries = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for t, m in enumerate(_blocks(radius))))
    return fps.select("fp", F.explode(entries).alias("e")).select("e.t", "e.block", "fp")



def _dense_links(dense: DataFrame, radius: int) -> DataFrame:
    """Links inside blocks with very many fingerprints, without their pairs.

    Two fingerprints x, y are within ``radius`` r exactly if some word z lies
    within r - r // 2 of x and r // 2 of y.  Each fingerprint is put under all
    words within r - r // 2 flips of the bits outside its blocks, marked near
    if within r // 2.  Under one word with a near member m, every member is
    within r of m: all of them link to the least near member.  So the links
    kept are a star for each word, which leaves the connected components as
    all pairs would, and the rows grow in proportion to the fingerprints.
    """
    far, near = radius - radius // 2, radius // 2
    tables = []
    for t, mask in enumerate(_blocks(radius)):
        free = [b for b in range(64) if not mask >> b & 1]
        flips = [(0, True)] + [
            (_signed(sum(1 << b for b in c)), k <= near) for k in range(1, far + 1) for c in combinations(free, k)
        ]
        tables.append((t, [f for f, _ in flips], [n for _, n in flips]))
    spark = dense.sparkSession
    rows = spark.createDataFrame(tables, "t int, flips array<long>, near array<boolean>")
    put = (
        dense.join(F.broadcast(rows), "t")  # one row for each pair of blocks: 10 rows at radius 3
        .select("fp", F.explode(F.arrays_zip("flips", "near")).alias("z"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("z.flips")).alias("word"), F.col("z.near").alias("near"))
    )
    hub = put.where("near").groupBy("word").agg(F.min("fp").alias("hub"))
    return put.join(hub, "word").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def links(ws: Workspace, fps: DataFrame, radius: int = 3, dense_from: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that keep every component.

    ``fps``: distinct fingerprints.  Blocks of up to ``dense_from``
    fingerprints are searched pair by pair, larger ones by ``_dense_links``;
    both are exact, and ``dense_from`` is about where their costs cross.
    """
    keyed = _keyed(fps, radius)
    counts = keyed.groupBy("t", "block").agg(F.count("*").alias("n"))
    shared = ws.keep(counts.where("n > 1"), "blocks")
    some = keyed.join(shared.where(F.col("n") <= dense_from).select("t", "block"), ["t", "block"])
    left = some.select("t", "block", F.col("fp").alias("a"))
    right = some.select("t", "block", F.col("fp").alias("b"))
    pairs = (
        left.join(right, ["t", "block"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .select("a", "b")
        .distinct()
    )
    big = shared.where(F.col("n") > dense_from)
    if big.isEmpty():
        return pairs
    return pairs.unionByName(_dense_links(keyed.join(big.select("t", "block"), ["t", "block"]), radius))


def components(
    spark: SparkSession, docs: DataFrame, words: int = 3, radius: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    ws = Workspace(spark, "simhash")
    found = ws.keep(fingerprints(docs, words, key, text), "fps")
    least = ws.keep(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    edges = ws.keep(links(ws, least.select("fp"), radius), "edges")
    roots = connected_components(ws, edges)
    members = roots.join(least.withColumnRenamed("fp", "node"), "node")
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = members.join(ids, "root").select(F.col("node").alias("fp"), "component_id")
    final = ws.keep(
        least.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "final"
    )
    return found.join(final, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


_SEEDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03))


def _mixed(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h * seed + seed
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Four 64-bit words over different hashes, each given once."""
    out = np.zeros(len(_SEEDS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _CHUNK):
            part = _mixed(hashes[at : at + _CHUNK], seed)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def _two_fingerprints(text: str | None, words: int) -> np.ndarray:
    """Eight words: over the different words of a text, and over its different shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    width = min(words, len(tokens))
    if not width:
        return np.zeros(2 * len(_SEEDS), np.uint64)
    single = np.fromiter(map(digest, set(tokens)), np.uint64)
    run = zip(*(tokens[k:] for k in range(width)), strict=False)
    shingles = np.unique(np.fromiter((digest(join(x)) for x in run), np.uint64, len(tokens) - width + 1))
    return np.concatenate([wide_fingerprint(single), wide_fingerprint(shingles)])


def _tree_links(ids: np.ndarray, prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join all members of one block that are connected within ``most`` bits.

    Every member reached is taken out of what is still looked through, so a
    dense group costs about as much as its members, and no more than one link
    is made for each member.
    """
    out, rest = [], np.arange(len(ids))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]).sum(1, dtype=np.int64) <= most
            out += [(int(ids[at]), int(ids[x])) for x in rest[near]]
            front += rest[near].tolist()
            rest = rest[~near]
    return out


#: Members of a dense block that are tried as the centre of its largest group.
_HUBS = 8


def _spread_links(ws: Workspace, dense: DataFrame, shown: list[str], most: int, size: int) -> DataFrame:
    """Links inside blocks with more than ``size`` members, which no task holds whole.

    ``dense``: block, n (its members), rep, the shingle fingerprint.  Eight
    members of a block are compared with all its members, which costs in
    proportion to them; a large group of near copies is then one star.  Only
    members outside the largest star meet the whole block, in parts of about
    ``size`` by ``size`` that are searched apart and give a tree each.  Two
    members in the star are connected by its hub, and any other pair meets in
    one part, so no class is lost.
    """
    near = lambda hub: sum((F.bit_count(F.col(c).bitwiseXOR(hub[c])) for c in shown), F.lit(0)) <= most
    hubs = dense.groupBy("block").agg(
        *(F.min(F.struct(F.xxhash64(F.lit(k), "rep").alias("h"), "rep", *shown)).alias(f"hub{k}") for k in range(_HUBS))
    )
    stars = F.array(*(F.when(near(F.col(f"hub{k}")), F.col(f"hub{k}.rep")) for k in range(_HUBS)))
    met = ws.keep(dense.join(hubs, "block").select("block", "n", "rep", *shown, stars.alias("stars")), "met")
    sums = met.groupBy("block").agg(*(F.count(F.col("stars")[k]).alias(f"s{k}") for k in range(_HUBS)))
    every = [F.col(f"s{k}") for k in range(_HUBS)]
    best = sums.select("block", F.array_position(F.array(*every), F.greatest(*every)).cast("int").alias("best"))
    rest = met.join(best, "block").where(F.element_at("stars", F.col("best")).isNull()).select("block", "n", "rep", *shown)
    rest = ws.keep(rest, "rest")
    star = met.select(F.col("rep").alias("a"), F.explode("stars").alias("b")).where("b IS NOT NULL AND a <> b")
    left_over = rest.groupBy("block").agg(F.count("*").alias("m"))
    part = lambda what, parts: F.pmod(F.xxhash64(F.lit(what), "rep"), F.col(parts)).cast("int").alias(what)
    spread = lambda what, parts: F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)).alias(what)
    sized = lambda rows: rows.join(left_over, "block").withColumns({"rs": F.ceil(F.col("m") / size), "cs": F.ceil(F.col("n") / size)})
    one = sized(rest).select("block", "rep", *shown, part("r", "rs"), spread("c", "cs"))
    other = sized(met).select("block", "rep", *shown, part("c", "cs"), spread("r", "rs"))

    def link(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        own = pd.concat([a, b]).drop_duplicates("rep")
        prints = np.ascontiguousarray(own[shown].to_numpy(np.int64)).view(np.uint64)
        pairs = _tree_links(own["rep"].to_numpy(np.int64), prints, most) if len(own) else []
        return pd.DataFrame(np.array(pairs, np.int64).reshape(-1, 2), columns=["a", "b"])

    keys = ["block", "r", "c"]
    return star.unionByName(one.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(link, "a long, b long"))


def near_classes(
    spark: SparkSession, docs: DataFrame, words: int = 5, most: int = 44, key: str = "doc_id", text: str = "text", dense_from: int = 4096
) -> DataFrame:
    """doc_id, component_id of every row with a known id: classes of near copies.

    Two texts link if their shingle fingerprints differ in ``most`` or fewer of
    256 bits; at a shingle similarity of 0.8 the mean is about 37 and 95 of 100
    pairs are below 44.  A candidate pair agrees on two of five blocks of one of
    four word fingerprints, which 98 to 100 of 100 pairs at 0.8 do.  Equal
    fingerprints are collapsed first; members of a block are streamed through
    one sorted pass and give a tree of links, not pairs.  Blocks of more than
    ``dense_from`` members are searched in parts by ``_spread_links``.
    """
    ws = Workspace(spark, "near")
    names = [f"f{i}" for i in range(2 * len(_SEEDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([_two_fingerprints(t, words) for t in b.column(1).to_pylist()], np.uint64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fps.T)], ["doc_id", *names])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    found = ws.keep(rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)])), "fps")
    least = ws.keep(found.groupBy(*names).agg(F.min("doc_id").alias("rep")), "least")
    shown = names[len(_SEEDS) :]
    entries = F.array(*(
        F.xxhash64(F.lit(t), F.lit(n), F.col(n).bitwiseAND(F.lit(_signed(m)))) for n in names[: len(_SEEDS)] for t, m in enumerate(_blocks(3))
    ))
    keyed = least.select("rep", *shown, F.explode(entries).alias("block"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of a block that may go on in the next batch

        def out(rows: np.ndarray) -> pa.RecordBatch:
            block = rows[:, 0]
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            pairs = []
            for k in np.flatnonzero(np.diff(cuts) > 1):
                own = rows[cuts[k] : cuts[k + 1]]
                pairs += _tree_links(own[:, 1], own[:, 2:].view(np.uint64), most)
            a = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in b.columns], axis=1)
            if held and rows[-1, 0] == held[0][0, 0]:
                held.append(rows)
                continue
            start = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if held or start:
                yield out(np.concatenate([*held, rows[:start]]))
            held = [rows[start:]]
        if held:
            yield out(np.concatenate(held))

    # summed in each task first, so a block that very many rows share is no hot key here
    dense = ws.keep(keyed.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > dense_from), "dense")
    any_dense = not dense.isEmpty()
    sparse = keyed.join(dense.select("block"), "block", "left_anti") if any_dense else keyed
    dealt = sparse.select("block", "rep", *shown).repartition(parts, "block").sortWithinPartitions("block", "rep")
    found_links = dealt.mapInArrow(link, "a long, b long")
    if any_dense:
        members = ws.keep(keyed.join(dense, "block").select("block", "n", "rep", *shown), "members")
        found_links = found_links.unionByName(_spread_links(ws, members, shown, most, dense_from))
    edges = ws.keep(found_links.distinct(), "edges")
    roots = connected_components(ws, edges).select(F.col("node").alias("rep"), F.col("root").alias("component_id"))
    classes = ws.keep(least.join(roots, "rep", "left").select(*names, F.coalesce("component_id", "rep").alias("component_id")), "classes")
    return found.join(classes, names).select("doc_id", "component_id")
