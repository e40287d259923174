"""Brown class-based n-gram language model.

    p(w_i | w_{i-1}) = p(class_i | class_{i-1}) * p(w_i | class_i)

Words are put into classes by exchange clustering: the most frequent words
(``exchanged``) move, one at a time on the driver, to the class that raises the
likelihood of the class bigrams most, until a pass moves none.  Every other
word of the training texts begins in a class by its form (its last letters,
length and ending) and then moves, on the workers, to the class that raises the
likelihood most: in slices of words, each against the counts that the slices
before have left.  A word not in the training texts is taken for one of the
classes that words of its form, seen once, are in.  Both probabilities are
smoothed: transitions by interpolation with the class unigram, emissions by
adding ``alpha`` to the count of each known word and of one unknown word in a
class.

Counts, transitions, the vocabulary and the number of words in each class are
taken over all training documents.  One pass over the texts counts words, a
second writes every text as numbers, which the others read.  Which words move
on the driver is bounded (``exchanged``), and with it the number of bigrams
brought there.  The counts and classes of the ``held`` most frequent words are
sent to every worker.  Those of all other words stay distributed and meet the
documents in a join on their hash, after the occurrences in each document are
summed; the most frequent words are not in that join, so it has no hot key.
Which words are held changes no score.

Texts are cut into words a slice at a time, so a worker's memory does not
follow the length of a text.  Words are joined by XXH64 (seed 42) of their
bytes.  Defined results: a null text counts
as empty; an empty text is one end token; rows with equal ids are scored each;
null ids are scored and learnt from; with no training text all counts are 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

# capitals to small letters, white space to a space
_TABLE = bytes(0x20 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b""  # no word is empty, so the end token is
#: Different words or pairs that a task counts before it sends them on.
_FLUSH = 400_000
#: Bytes of text cut into words at once.
_SLICE = 1 << 20
#: Tokens that are counted at once.
_SPAN = 1 << 18
#: Parts that the words with a place of their own are put into while they move.
_BUCKETS = 16


@dataclass(frozen=True)
class BrownParams:
    held: int = 131_072  # words whose counts are sent to every worker, at most
    exchanged: int = 3000  # of those, words that move one at a time, on the driver
    classes: int = 64
    forms: int = 256
    passes: int = 6
    alpha: float = 0.5
    backoff: float = 20.0
    first: float = 0.002  # share of the other words that move at once at first
    growth: float = 0.25  # of all words moved so far, how many move at once


def slices(texts: list[str | None]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The lower-cased words of all texts in a row, one end after each text, and the number of the text of each.

    Cut into lists of about ``_SLICE`` bytes; a long text goes on in the next list.
    """
    words: list[bytes] = []
    of: list[int] = []
    sizes: list[int] = []
    size = 0

    def out() -> tuple[list[bytes], np.ndarray]:
        return words, np.repeat(np.array(of, np.int64), sizes)

    for n, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
        at = 0
        while True:
            end = len(raw)
            if end - at > _SLICE:
                end = raw.rfind(b" ", at, at + _SLICE) + 1 or raw.find(b" ", at + _SLICE) + 1 or len(raw)
            some = raw[at:end].split()
            if end == len(raw):
                some.append(END)
            words += some
            of.append(n), sizes.append(len(some))
            size += end - at
            at = end
            if size >= _SLICE:
                yield out()
                words, of, sizes, size = [], [], [], 0
            if at == len(raw):
                break
    if words:
        yield out()


def form(word: bytes, forms: int) -> int:
    """The class of a word by its form."""
    stem = word.rstrip(b".,;:!?%&$#*\"')|")
    return xxhash.xxh32_intdigest(stem[-2:] + b"%d%d" % (len(word) - len(stem) > 0, min(len(stem) // 4, 3))) % forms


def exchange(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, n_classes: int, passes: int) -> np.ndarray:
    """Classes of words 0..n-1 (in order of frequency) from their bigrams: (first, second, count) arrays."""
    k = min(n_classes, n)
    of = np.arange(n) % max(k, 1)
    if n == 0:
        return of
    first, second, times = pairs
    times = times.astype(float)
    loop_at = first == second
    loops = np.bincount(first[loop_at], times[loop_at], n)

    def rows(key: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbours of each word in one array: (where each word begins, neighbours, counts)."""
        order = np.argsort(key[~loop_at], kind="stable")
        return np.searchsorted(key[~loop_at][order], np.arange(n + 1)), other[~loop_at][order], times[~loop_at][order]

    r_at, r_to, r_n = rows(first, second)
    l_at, l_to, l_n = rows(second, first)
    grid, out, into = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    np.add.at(grid, (of[first], of[second]), times)
    sums_out, sums_in = np.bincount(first, times, n), np.bincount(second, times, n)
    np.add.at(out, of, sums_out), np.add.at(into, of, sums_in)
    ent = lambda x: x * np.log(np.maximum(x, 1e-300))
    parts = ent(grid)  # kept in step with grid

    def changed(c: int) -> None:
        parts[c], parts[:, c] = ent(grid[c]), ent(grid[:, c])

    for _ in range(passes):
        moved = 0
        for w in range(n):
            own = of[w]
            mine = slice(r_at[w], r_at[w + 1])
            r = np.bincount(of[r_to[mine]], r_n[mine], k)
            mine = slice(l_at[w], l_at[w + 1])
            l_ = np.bincount(of[l_to[mine]], l_n[mine], k)
            loop = loops[w]
            # without w
            grid[own] -= r
            grid[:, own] -= l_
            grid[own, own] -= loop
            out[own] -= sums_out[w]
            into[own] -= sums_in[w]
            changed(own)
            # what each class would gain by w: rows, columns, the crossing, the totals; only classes beside w count
            after, before = np.flatnonzero(r), np.flatnonzero(l_)
            gain = (ent(grid[:, after] + r[after]) - parts[:, after]).sum(1) + (ent(grid[before] + l_[before, None]) - parts[before]).sum(0)
            d = np.arange(k)
            diag = grid[d, d]
            gain += ent(diag + r + l_ + loop) - ent(diag + r) - ent(diag + l_) + ent(diag)
            gain -= ent(out + sums_out[w]) - ent(out) + ent(into + sums_in[w]) - ent(into)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            of[w] = best
            grid[best] += r
            grid[:, best] += l_
            grid[best, best] += loop
            out[best] += sums_out[w]
            into[best] += sums_in[w]
            changed(best)
        if not moved:
            break
    return of


def _flush(counts: Counter, keys: list[str]) -> Iterator[pa.RecordBatch]:
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], keys)
        counts.clear()


def _counted(docs: DataFrame) -> DataFrame:
    """(word binary, n): words of all texts, the end too; summed in each task, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for words, _ in slices(b.column(0).to_pylist()):
                counts.update(words)
                if len(counts) > _FLUSH:
                    yield from _flush(counts, ["word", "n"])
        yield from _flush(counts, ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _heads(vocabulary: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, ``most`` of them at most, and their counts; the most frequent first, ties by word.

    They are cut by frequency, in steps of about one part in a hundred (small
    counts exactly), so no task merges the first words of every other task.
    """
    step = F.floor(F.log2("n") * 64).cast("int")
    sizes = sorted(((r[0], r[1]) for r in vocabulary.groupBy(step.alias("step")).count().collect()), reverse=True)
    edge, held = (sizes[0][0] + 1 if sizes else 0), 0
    for at, words in sizes:
        held += words
        if held > most:
            break
        edge = at
    got = vocabulary.where(step >= edge).toArrow()
    words, times = got.column(0).to_pylist(), got.column(1).to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-times[i], words[i]))
    return [words[i] for i in order], np.array([times[i] for i in order], float)


class Places:
    """A number for every word: ``heads`` by their order, any other word len(heads) + its form."""

    def __init__(self, heads: list[bytes], forms: int) -> None:
        self.heads, self.forms = heads, forms
        self.known = dict(zip(heads, range(len(heads)), strict=True))

    def __reduce__(self):  # noqa: ANN204
        return Places, (self.heads, self.forms)

    def of(self, words: list[bytes]) -> np.ndarray:
        found, at, known, first = list(map(self.known.get, words)), -1, self.known, len(self.heads)
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            w = words[at]
            found[at] = known.get(w, -1)
            if found[at] < 0:
                if len(known) > first + _REMEMBERED:
                    known = self.known = dict(zip(self.heads, range(first), strict=True))
                found[at] = known[w] = first + form(w, self.forms)
        return np.array(found, np.int64)


#: Words besides the heads whose form a worker remembers; forgotten when full.
_REMEMBERED = 200_000


def _coded(rows: DataFrame, places: Places, base: np.ndarray, room: float) -> DataFrame:
    """Every row's text as places, with the XXH64 of each word that has only its form's place.

    doc_id, held_out, n_tokens and what the words with a place of their own add to n_known and base_score.
    """
    end = len(places.heads) - 1
    shared = rows.sparkSession.sparkContext.broadcast((places, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, base = shared.value
        for b in batches:
            n = b.num_rows
            ids, of, hashes, whose, n_in, sums = [], [], [], [], np.zeros(n, np.int64), np.zeros(n)
            for words, text in slices(b.column(0).to_pylist()):
                at = places.of(words)
                rare = np.flatnonzero(at > end)
                n_in += np.bincount(text[np.isfinite(base[at])], minlength=n)
                sums += np.bincount(text, np.where(np.isfinite(base[at]), base[at], 0) - room, n)
                ids.append(at.astype(np.int32)), of.append(np.bincount(text, minlength=n))
                hashes.append(np.array([xxhash.xxh64_intdigest(words[i], 42) for i in rare.tolist()], np.uint64).view(np.int64))
                whose.append(np.bincount(text[rare], minlength=n))
            n_tok, n_rare = (sum(x, np.zeros(n, np.int64)) for x in (of, whose))
            cut = lambda sizes: pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(cut(n_tok), join(ids, np.int32)), pa.ListArray.from_arrays(cut(n_rare), join(hashes, np.int64)),
                    b.column(1), b.column(2), pa.array(n_tok), pa.array(n_in), pa.array(sums),
                ],
                ["ids", "hashes", "doc_id", "held_out", "n_tokens", "n_in", "base"],
            )

    return rows.select("text", "doc_id", "held_out").mapInArrow(
        run, "ids array<int>, hashes array<long>, doc_id long, held_out boolean, n_tokens long, n_in long, base double"
    )


def _spans(ids: np.ndarray, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(where, places before, places, places after) over ``_SPAN`` tokens at a time; texts end with ``end``."""
    padded = np.r_[np.int32(end), ids, np.int32(end)]
    for lo in range(0, len(ids), _SPAN):
        hi = min(lo + _SPAN, len(ids))
        yield lo, padded[lo:hi], padded[lo + 1 : hi + 1], padded[lo + 2 : hi + 2]


def _pairs(coded: DataFrame, code: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of codes 0..n-1 of the places over all rows: (first, second, count) arrays, at most n * n.

    A text begins after the end.  Places whose code is -1 are in no bigram.
    """
    shared = coded.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, held, size = shared.value, [], 0
        dense = np.zeros(n * n if n * n <= _FLUSH else 0, np.int64)

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, inverse = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(inverse, np.concatenate([c for _, c in held]), len(pairs)).astype(np.int64)

        for b in batches:
            for _, before, ids, _ in _spans(b.column(0).flatten().to_numpy(), end):
                x, y = code[before], code[ids]
                pairs = (x * n + y)[(x >= 0) & (y >= 0)]
                if len(dense):
                    dense += np.bincount(pairs, minlength=n * n)
                    continue
                held.append(np.unique(pairs, return_counts=True))
                size += len(held[-1][0])
                if size > 4 * _FLUSH:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > 2 * _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["pair", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "n"])
        at = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dense[at])], ["pair", "n"])

    return _cells(coded.select("ids").mapInArrow(run, "pair long, n long"), n)


def _cells(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, count) arrays of the sums of (pair, n)."""
    table = counts.groupBy("pair").agg(F.sum("n").alias("n")).select(F.col("pair").cast("long"), F.col("n").cast("long")).toArrow()
    pair, times = (table.column(i).to_numpy() for i in (0, 1))
    return pair // n, pair % n, times


def _ent(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


class Mover:
    """Chooses the class of each word that raises the likelihood most, all against the same counts.

    ``grid[c, k]``: how often a word of class k stands before context c, and
    ``grid[C + c, k]``: behind it.
    """

    SMALL = 8

    def __init__(self, grid: np.ndarray, classes: int) -> None:
        self.grid, self.classes, self.n = grid, classes, grid.shape[1]
        self.sums = np.array([grid[: self.n].sum(0), grid[self.n :].sum(0)])
        self.steps: list[np.ndarray] = []  # worked out once in each worker

    def _grown(self, which: int, row: np.ndarray, own: np.ndarray, times: np.ndarray) -> np.ndarray:
        """By class, what ``times`` more in a row's cells add to the sum of x log x; in the own class they are there already."""
        if not self.steps:
            self.steps = [np.array([_ent(g + k) - _ent(g) for k in range(1, self.SMALL + 1)]) for g in (self.grid, self.sums)]
        g, small = (self.grid, self.sums)[which], times <= self.SMALL
        out = self.steps[which][np.minimum(times, self.SMALL) - 1, row]
        if not small.all():
            big = g[row[~small]]
            out[~small] = _ent(big + times[~small, None]) - _ent(big)
        at = np.arange(len(row))
        there = g[row, own]
        out[at, own] = _ent(there) - _ent(np.maximum(there - times, 0))
        return out

    def choose(self, starts: np.ndarray, own: np.ndarray, row: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Classes of words whose contexts (row of the grid, count) begin at ``starts``."""
        whose = own[np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(row)]))]
        gain = np.add.reduceat(self._grown(0, row, whose, times), starts, axis=0)
        total = np.add.reduceat(np.where(row < self.n, times, 0), starts)
        for side in (0, 1):
            gain -= self._grown(1, np.full(len(own), side), own, total)
        at, best = np.arange(len(own)), gain[:, : self.classes].argmax(1)
        return np.where(gain[at, best] <= gain[at, own] + 1e-9, own, best)


_MOVED = ["key", "class", "form", "n", "cell"]


class Moves:
    """What a task makes of contexts: (key, class, form, n) of each word and, with a null key, (cell, n): how the grid changes."""

    def __init__(self, mover: Mover, p: BrownParams) -> None:
        self.n, self.p, self.mover = mover.n, p, mover
        self.change = np.zeros(2 * self.n * self.n, np.int64)

    def words(self, key: np.ndarray, form_: np.ndarray, row: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        """Contexts of whole words, in order of key and row."""
        n, starts = self.n, np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        own = self.p.classes + form_[starts]
        best = self.mover.choose(starts, own, row, times)
        sizes = np.diff(np.r_[starts, len(key)])
        np.add.at(self.change, row * n + np.repeat(best, sizes), times)
        np.add.at(self.change, row * n + np.repeat(own, sizes), -times)
        total = np.add.reduceat(np.where(row < n, times, 0), starts)
        return pa.RecordBatch.from_arrays([pa.array(key[starts]), pa.array(best), pa.array(form_[starts]), pa.array(total), pa.nulls(len(starts), pa.int64())], _MOVED)

    def changes(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.change)
        null = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays([null, null, null, pa.array(self.change[at]), pa.array(at)], _MOVED)


def _move(contexts: DataFrame, grid: np.ndarray, forms: np.ndarray, members: np.ndarray, p: BrownParams) -> DataFrame:
    """The moves of all words in ``contexts``; ``members``: the words among them that have a place, in order.

    Contexts of words with a place are counted as they come, in a table of a
    bucket's words; those of other words come sorted by word.
    """
    n = grid.shape[1]
    shared = contexts.sparkSession.sparkContext.broadcast((Mover(grid, n - 1), forms, members))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mover, forms, members = shared.value
        moves, tables = Moves(mover, p), {}
        for b in batches:
            for bucket, codes in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                mine = members[members % _BUCKETS == bucket]
                table = tables.setdefault(bucket, np.zeros((len(mine), 2 * n), np.int32))
                code = codes.values.to_numpy()
                word = np.searchsorted(mine, code // (n * n))
                code = code % (n * n)
                np.add.at(table, (word, code % n), 1)
                np.add.at(table, (word, n + code // n), 1)
        for bucket in sorted(tables):
            mine, table = members[members % _BUCKETS == bucket], tables.pop(bucket)
            for lo in range(0, len(mine), 32):
                word, row = np.nonzero(table[lo : lo + 32])
                if len(word):
                    key = mine[lo : lo + 32][word]
                    yield moves.words(key, forms[key], row, table[lo : lo + 32][word, row].astype(np.int64))
        yield moves.changes()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Moves(shared.value[0], p)
        none = np.zeros(0, np.int64)
        rest = (none, none, none, none)  # of the last word, which may go on in the next batch
        for b in batches:
            key, code = (b.column(i).to_numpy() for i in (0, 1))
            if not len(key):
                continue
            form_, code = code % p.forms, code // p.forms
            row = np.concatenate([rest[2], code % n, n + code // n])
            key, form_, times = (np.concatenate(x) for x in ((rest[0], key, key), (rest[1], form_, form_), (rest[3], np.ones(2 * len(code), np.int64))))
            order = np.lexsort((row, key))
            key, form_, row, times = key[order], form_[order], row[order], times[order]
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
            key, form_, row, times = key[new], form_[new], row[new], np.add.reduceat(times, new)
            cut = int(np.searchsorted(key, key[-1]))
            rest = tuple(x[cut:] for x in (key, form_, row, times))
            if cut:
                yield moves.words(*(x[:cut] for x in (key, form_, row, times)))
        if len(rest[0]):
            yield moves.words(*rest)
        yield moves.changes()

    schema = ", ".join(f"{c} long" for c in _MOVED)
    held = contexts.where("bucket >= 0").select("bucket", "codes").repartition(_BUCKETS, "bucket").mapInArrow(placed, schema)
    rest = contexts.where("bucket < 0").select(F.explode(F.arrays_zip("keys", "codes")).alias("x")).select("x.keys", "x.codes")
    return held.unionByName(rest.repartition("keys").sortWithinPartitions("keys").mapInArrow(joined, schema))


def _edges(p: BrownParams) -> np.ndarray:
    """Where the slices end, as shares of the words."""
    edges = [p.first]
    while edges[-1] < 1:
        edges.append(edges[-1] * (1 + p.growth))
    return np.array(edges[:-1])


def _slice(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Slices of words by their hashes."""
    part = (hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    return np.searchsorted(edges, part / float(1 << 53), side="right")


def _spread(coded: DataFrame, kind: np.ndarray, forms: np.ndarray, slice_of: np.ndarray, m: int, end: int, p: BrownParams) -> DataFrame:
    """(slice, bucket, keys, codes): every occurrence of a word that the driver does not move.

    Of words with a place: by bucket, codes of the word and the classes after
    and before it.  Of others, whose bucket is -1: the hash, and codes of the
    classes and the form.
    """
    n, edges = p.classes + p.forms + 1, _edges(p)
    shared = coded.sparkSession.sparkContext.broadcast((kind, forms, slice_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, forms, slice_of = shared.value
        for b in batches:
            hashes, met, found = b.column(1).flatten().to_numpy(), 0, []
            for _, before, ids, after in _spans(b.column(0).flatten().to_numpy(), end):
                at = np.flatnonzero((ids >= m) & (ids != end))
                place = ids[at].astype(np.int64)
                code = kind[before[at]] * n + kind[after[at]]
                rare = place > end
                h = hashes[met : met + int(rare.sum())]
                met += len(h)
                held = place[~rare]
                found.append((slice_of[held] * _BUCKETS + held % _BUCKETS, np.zeros(len(held), np.int64), held * n * n + code[~rare]))
                found.append(((_slice(h, edges) + len(edges) + 1) * _BUCKETS, h, code[rare] * p.forms + forms[place[rare]]))
            group, keys, codes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
            order = np.argsort(group, kind="stable")
            group, keys, codes = group[order], keys[order], codes[order]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            slices_, buckets = group[starts] // _BUCKETS, group[starts] % _BUCKETS
            rare = slices_ > len(edges)
            cuts = np.r_[starts, len(group)].astype(np.int32)
            sizes = np.diff(cuts) * rare
            kept = np.repeat(rare, np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.where(rare, slices_ - len(edges) - 1, slices_)), pa.array(np.where(rare, -1, buckets)),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(keys[kept])),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(codes)),
                ],
                ["slice", "bucket", "keys", "codes"],
            )

    return coded.select("ids", "hashes").mapInArrow(run, "slice long, bucket long, keys array<long>, codes array<long>")


def _rest_classes(
    ws: Workspace, coded: DataFrame, kind: np.ndarray, forms: np.ndarray, hashes: np.ndarray, grid: np.ndarray, m: int, end: int, p: BrownParams
) -> DataFrame:
    """(key, class, form, n) of every training word that the driver does not move; ``key``: its place or else its hash.

    They move in slices, which grow; all words of a slice move against the
    counts that the slices before have left.  The first slices are small, as
    many words that move at once would all take the same class.  The slice
    follows the hash, so which words have a place changes nothing.
    """
    spark, path, out = ws.spark, ws.path("contexts"), ws.path("words")
    slice_of = _slice(hashes, _edges(p))
    _spread(coded, kind, forms, slice_of, m, end, p).write.partitionBy("slice").parquet(path)
    contexts = spark.read.schema("bucket long, keys array<long>, codes array<long>, slice long").parquet(path)
    n = grid.shape[1]
    both = np.concatenate([grid.T, grid])
    done = []
    for (at,) in sorted(contexts.select("slice").distinct().collect()):
        done.append(f"{out}/{at}")
        members = np.arange(m, end)[slice_of[m:end] == at]
        _move(contexts.where(F.col("slice") == at), both, forms, members, p).write.parquet(done[-1])
        step = spark.read.schema("n long, cell long").parquet(done[-1]).where("cell IS NOT NULL")
        row, to, times = _cells(step.select(F.col("cell").alias("pair"), "n"), n)
        both[row, to] += times
    schema = ", ".join(f"{c} long" for c in _MOVED)
    words = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    return words.where("cell IS NULL").drop("cell")


def _summed(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of the columns and how often each stands there."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    if not len(order):
        return columns, np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    return [c[new] for c in columns], np.diff(np.r_[new, len(order)])


def _joined(coded: DataFrame, words: DataFrame, kind: np.ndarray, end: int, p: BrownParams) -> DataFrame:
    """(row, train, before, class, after, n, times) for each word that has no place of its own.

    ``before`` and ``after`` are classes, -1 where the neighbour has no place
    either: such neighbours have a row of their own, whose ``n`` is -1.
    """
    n = p.classes + p.forms + 1
    shared = coded.sparkSession.sparkContext.broadcast(kind)
    docs = coded.select("ids", "hashes", "row", F.expr("NOT held_out").alias("train")).where("size(hashes) > 0")

    def each(neighbours: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = shared.value
            for b in batches:
                hashes, met = b.column(1).flatten().to_numpy(), 0
                stops = b.column(0).value_lengths().to_numpy().cumsum()
                for lo, before, ids, after in _spans(b.column(0).flatten().to_numpy(), end):
                    at = np.flatnonzero(ids > end)
                    h = hashes[met : met + len(at) + 1]  # one more, for a neighbour
                    met += len(at)
                    doc = np.searchsorted(stops, lo + at, side="right")
                    if neighbours:
                        two = np.flatnonzero(after[at] > end)
                        code = (ids[at[two]] - end - 1).astype(np.int64) * p.forms + after[at[two]] - end - 1
                        (code, right, left, doc), times = _summed(code, h[two + 1], h[two], doc[two])
                        columns = [left, right]
                    else:
                        code = ((kind[before[at]] + 1) * (n + 1) + kind[after[at]] + 1) * p.forms + ids[at] - end - 1
                        (code, left, doc), times = _summed(code, h[: len(at)], doc)
                        columns = [left]
                    doc = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, columns), pa.array(code), pa.array(times), b.column(2).take(doc), b.column(3).take(doc)],
                        [*("key", "right")[: len(columns)], "code", "times", "row", "train"],
                    )

        return run

    rest = "code long, times long, row long, train boolean"
    known = words.select("key", "class", "n")
    unseen = lambda c: F.coalesce("class", c + n)
    part = lambda by, size: (F.floor(F.col("code") / by) % size).cast("long")
    one = docs.mapInArrow(each(False), f"key long, {rest}").join(known, "key", "left").select(
        "row", "train", (part(p.forms * (n + 1), n + 1) - 1).alias("before"), unseen(part(1, p.forms)).alias("class"),
        (part(p.forms, n + 1) - 1).alias("after"), F.coalesce("n", F.lit(0)).alias("n"), "times",
    )
    two = docs.mapInArrow(each(True), f"key long, right long, {rest}").join(known.drop("n"), "key", "left").select(
        "row", "train", unseen(part(p.forms, p.forms)).alias("before"), F.col("right").alias("key"), "code", "times"
    ).join(known.drop("n"), "key", "left").select(
        "row", "train", "before", unseen(part(1, p.forms)).alias("class"), F.lit(-1).cast("long").alias("after"), F.lit(-1).cast("long").alias("n"), "times"
    )
    return one.unionByName(two)


def _joined_pairs(joined: DataFrame, n: int) -> DataFrame:
    """(pair, n): class bigrams of training texts with a word that has no place of its own."""
    train = joined.where("train").select("before", "class", "after", "times")
    return train.where("before >= 0").select((F.col("before") * n + F.col("class")).alias("pair"), F.col("times").alias("n")).unionByName(
        train.where("after >= 0").select((F.col("class") * n + F.col("after")).alias("pair"), F.col("times").alias("n"))
    )


def _steps(grid: np.ndarray, kinds: np.ndarray, once: np.ndarray, p: BrownParams) -> np.ndarray:
    """log10 of p(class | class before) / the class's room; unseen words of each form are more rows and columns.

    ``once[c, f]``: words of class c and form f that were seen once.  The one
    unknown word of a class is shared by the forms as those are.
    """
    seen = grid.sum(0)
    unigram = (seen + 1) / (seen.sum() + len(seen))
    moves = (grid + p.backoff * unigram) / (grid.sum(1, keepdims=True) + p.backoff)
    room = seen + p.alpha * (kinds + 1)
    by_form = (once.sum(0) + 1) / (once.sum() + p.forms)
    share = (once + by_form) / (once.sum(1, keepdims=True) + 1)
    of_form = (once + unigram[:, None]) / (once.sum(0) + 1)
    moves = np.concatenate([moves, of_form.T @ moves]) / room
    return np.log10(np.concatenate([moves, moves @ share], 1))


def score(docs: DataFrame, held: Column, p: BrownParams = BrownParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``held``: a condition on doc_id; the model learns from the other rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "brown")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("held_out", held)
    vocabulary = ws.keep(_counted(rows.where(~F.col("held_out"))), "vocabulary")
    total = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(total["n"] or 0), int(total["v"])
    heads, times = _heads(vocabulary.where(F.length("word") > 0), p.held)
    ends = vocabulary.where(F.length("word") == 0).first()
    # places: the heads, the end, then a place for every form; what has no count of its own here is joined
    end, m = len(heads), min(len(heads), p.exchanged)
    times = np.r_[times, float(ends["n"]) if ends else 0.0]
    own_base = np.r_[np.where(times > 0, np.log10(times + 1), -np.inf), np.full(p.forms, -np.inf)]
    coded = _coded(rows, Places([*heads, END], p.forms), own_base, float(np.log10(n_all + v_all + 1)))
    coded = ws.keep(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    train = coded.where(~F.col("held_out"))
    forms = np.r_[[form(w, p.forms) for w in heads], 0, np.arange(p.forms)].astype(np.int64)
    hashes = np.r_[np.array([xxhash.xxh64_intdigest(w, 42) for w in heads], np.uint64).view(np.int64), np.zeros(1 + p.forms, np.int64)]
    # the first classes: of the words that the driver moves, those of the exchange, of the others their form
    n = p.classes + p.forms + 1
    units = np.r_[np.arange(m), m + 1 + forms[m:end], m, m + 1 + np.arange(p.forms)]
    first, second, pair_times = _pairs(train, units, m + 1 + p.forms, end)
    inside = (first < m) & (second < m)
    classes = exchange((first[inside], second[inside], pair_times[inside]), m, p.classes, p.passes)
    unit_class = np.r_[classes, n - 1, np.arange(p.classes, n - 1)].astype(np.int64)
    grid = np.zeros((n, n))
    np.add.at(grid, (unit_class[first], unit_class[second]), pair_times)
    words = _rest_classes(ws, train, unit_class[units], forms, hashes, grid, m, end, p)
    # the last classes, of words with a place; -1 for the others
    kind = np.r_[unit_class[units[: end + 1]], np.full(p.forms, -1)]
    placed = words.where((F.col("key") >= 0) & (F.col("key") < end)).select("key", "class").toArrow()
    kind[placed.column(0).to_numpy()] = placed.column(1).to_numpy()
    joined = ws.keep(_joined(coded, words, kind, end, p), "joined")
    grid = np.zeros((n, n))
    for first, second, pair_times in (_pairs(train, kind, n, end), _cells(_joined_pairs(joined, n), n)):
        np.add.at(grid, (first, second), pair_times)
    kinds = np.bincount(kind[: end + 1][times > 0], minlength=n).astype(float)
    kinds[:] -= np.bincount(kind[m:end], minlength=n)  # these are in words, too
    once = np.zeros((n, p.forms))
    sizes = words.groupBy("class", "form").agg(F.count("*").alias("v"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"))
    for r in sizes.collect():
        kinds[r["class"]] += r["v"]
        once[r["class"], r["form"]] += r["once"]
    own_model = np.r_[np.log10(times + p.alpha), np.zeros(p.forms)]
    shared = spark.sparkContext.broadcast((kind, own_model, _steps(grid, kinds, once, p)))

    def placed_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, own, step = shared.value
        for b in batches:
            docs, model = np.repeat(np.arange(b.num_rows), b.column(0).value_lengths().to_numpy()), np.zeros(b.num_rows)
            for lo, before, ids, _ in _spans(b.column(0).flatten().to_numpy(), end):
                x, y = kind[before], kind[ids]
                model += np.bincount(docs[lo : lo + len(ids)], np.where((x >= 0) & (y >= 0), step[x, y], 0) + own[ids], b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(model), *b.columns[1:]], ["model", *b.schema.names[1:]])

    def joined_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, step = shared.value
        for b in batches:
            before, at, after, seen, times = (b.column(i).to_numpy() for i in range(1, 6))
            value = np.where(before >= 0, step[before, at], 0) + np.where(after >= 0, step[at, after], 0)
            value += np.where(seen >= 0, np.log10(np.maximum(seen, 0) + p.alpha), 0)
            base = np.log10(np.maximum(seen, 0) + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.where(seen > 0, times, 0)), pa.array(base * times), pa.array(value * times)], ["row", "r_in", "r_base", "r_model"]
            )

    part = coded.select("ids", "row", "doc_id", "held_out", "n_tokens", "n_in", "base").mapInArrow(
        placed_part, "model double, row long, doc_id long, held_out boolean, n_tokens long, n_in long, base double"
    )
    sums = joined.select("row", "before", "class", "after", "n", "times").mapInArrow(joined_part, "row long, r_in long, r_base double, r_model double")
    sums = sums.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("r_in", "r_base", "r_model")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return part.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_in") + zero("r_in")).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + zero("r_base")).alias("base_score"),
        (F.col("model") + zero("r_model")).alias("score"),
    )
