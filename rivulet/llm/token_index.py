"""Token ids in binary shards with a minimal perfect hash index.

``write`` orders the documents by key, cuts them into shards by range and
writes for each shard one payload file (ids as little-endian unsigned integers
of two or four bytes, as the vocabulary needs, document after document) and one
index file: a minimal perfect hash over the shard's distinct keys, and for each
of its slots a stored fingerprint, the offset and the number of ids.  A lookup
hashes the key, compares the fingerprint and reads one slice: constant time, no
search through the keys.

Shards follow the volume of text (``shard_count``), so an index, the one thing
that a task holds whole, has a bounded size.  Ranges are cut by key, then by a
hash of the text, then by the row's number, so even rows that all have one key
are spread over shards; a lookup then goes to the first shard of its key.

Index file, little endian: magic ``RVMP``, u32 version, u32 bytes an id, u64 keys, u64 buckets,
u64 salt, i32[buckets] displacements (>= 0: added to the hash, < 0: the slot
itself), u32[keys] fingerprints, u64[keys] offsets, u64[keys] lengths, then
u64 rows and the rows in order: i64[rows] keys, u8[rows] null flags,
u64[rows] lengths.

Files appear under their final name by one rename, and a repeated task writes
the same bytes under the same name, so lost executors and second attempts do
no harm.  They are written through pyarrow's file systems to the folder that
driver and executors share.

Defined results: a null text counts as empty; a row with an empty text has the
end id alone; rows with equal keys follow one another in a fixed order, and a
lookup gives the first of them; rows with a null key come first and cannot be
looked up; an empty table has no shards.  A key that was never written is
refused by its fingerprint (but for a chance of 2**-32).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace
from .tokens import wide, word_ids

_MAGIC, _VERSION = b"RVMP", 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def _hash(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(keys.astype("<i8").view(np.uint64) * _MIX[2] + np.uint64(salt))


@dataclass
class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys: hash and displace."""

    salt: int
    moves: np.ndarray
    n: int

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n, tries = len(keys), 64
        m = max(1, n // 3)
        for salt in range(1, 100):
            h = _hash(keys, salt)
            home = (h >> np.uint64(33)) % np.uint64(m)
            order = np.argsort(home, kind="stable")
            starts = np.searchsorted(home[order], np.arange(m + 1, dtype=np.uint64))
            moves, taken, done = np.zeros(m, np.int32), np.zeros(n, bool), True
            sizes = np.diff(starts)
            for b in np.argsort(-sizes, kind="stable"):
                own = h[order[starts[b] : starts[b + 1]]]
                if len(own) == 0:
                    break
                if len(own) == 1:
                    continue
                for first in range(0, 1 << 20, tries):
                    d = np.arange(first, first + tries, dtype=np.uint64)[:, None]
                    slots = cls._slots(own[None, :], d, n)
                    ordered = np.sort(slots, axis=1)
                    good = ~taken[slots].any(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
                    if good.any():
                        k = int(np.argmax(good))
                        moves[b], taken[slots[k]] = first + k, True
                        break
                else:
                    done = False
                    break
            if not done:
                continue
            free = np.flatnonzero(~taken)
            single = np.flatnonzero(sizes == 1)
            moves[single] = -1 - free[: len(single)].astype(np.int32)
            return cls(salt, moves, n)
        raise ValueError("keys are not distinct")

    @staticmethod
    def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(h + d * _MIX[2]) % np.uint64(n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        h = _hash(keys, self.salt)
        d = self.moves[((h >> np.uint64(33)) % np.uint64(len(self.moves))).astype(np.int64)]
        return np.where(d < 0, -1 - d.astype(np.int64), self._slots(h, np.maximum(d, 0).astype(np.uint64), self.n))


def marks(keys: np.ndarray) -> np.ndarray:
    """The 32-bit fingerprints that slots store."""
    return (_hash(keys, 0x5EED) & np.uint64(0xFFFFFFFF)).astype("<u4")


def pack_index(keys: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, width: int = 4) -> bytes:
    """An index file for rows in order: ``keys`` (0 where null), null flags, numbers of ids."""
    offsets = np.cumsum(lengths) - lengths
    real = np.flatnonzero(~nulls)
    distinct, first = np.unique(keys[real], return_index=True)
    first = real[first]
    n = len(distinct)
    mph = PerfectHash.build(distinct) if n else PerfectHash(0, np.zeros(1, np.int32), 0)
    prints, at, size = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u8")
    if n:
        slot = mph.slots(distinct)
        prints[slot], at[slot], size[slot] = marks(distinct), offsets[first], lengths[first]
    head = _MAGIC + struct.pack("<IIQQQ", _VERSION, width, n, len(mph.moves), mph.salt)
    tail = struct.pack("<Q", len(keys)) + keys.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + lengths.astype("<u8").tobytes()
    return head + mph.moves.astype("<i4").tobytes() + prints.tobytes() + at.tobytes() + size.tobytes() + tail


class ShardIndex:
    """A read index file."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != _MAGIC:
            raise ValueError("not an index file")
        version, self.width, n, m, salt = struct.unpack_from("<IIQQQ", raw, 4)
        if version != _VERSION:
            raise ValueError(f"index version {version}")
        at = 36
        self.kind = f"<u{self.width}"

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        self.hash = PerfectHash(salt, take("<i4", m), n)
        self.prints, self.offsets, self.lengths = take("<u4", n), take("<u8", n), take("<u8", n)
        (rows,) = struct.unpack_from("<Q", raw, at)
        at += 8
        self.row_keys, self.row_nulls, self.row_lengths = take("<i8", rows), take("u1", rows).astype(bool), take("<u8", rows)

    def find(self, key: int) -> tuple[int, int] | None:
        """(offset, number of ids) of a key, or None."""
        if self.hash.n == 0:
            return None
        k = np.array([key], np.int64)
        s = int(self.hash.slots(k)[0])
        return (int(self.offsets[s]), int(self.lengths[s])) if self.prints[s] == marks(k)[0] else None


def _open(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, parts: list[bytes]) -> None:
    store, path = _open(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for p in parts:
            out.write(p)
    store.move(own, path)


def _get(uri: str, start: int = 0, size: int | None = None) -> bytes:
    store, path = _open(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


_MANIFEST = "shard int, rows long, ids long, low long, high long"
#: Ids read at once.
_SPILL = 2 << 20


def write(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Write all shards under ``folder``; returns their manifest (written there too, as Parquet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        shard, tool = TaskContext.get().partitionId(), word_ids(vocabulary)
        end = np.array([end_id], tool.kind).tobytes()
        keys, nulls, lengths = [], [], []
        store = path = own = out = None
        for b in batches:
            ks = b.column(0)
            texts = b.column(1).to_pylist()
            if out is None and b.num_rows:
                store, path = fs.FileSystem.from_uri(f"{folder}/shard-{shard:06d}.ids")
                store.create_dir(path.rpartition("/")[0], recursive=True)
                own = f"{path}.{uuid.uuid4().hex}"
                out = store.open_output_stream(own)
            for at in range(0, len(texts), 256):
                got = [x + end for x in tool.many(texts[at : at + 256])]
                lengths += [len(x) // len(end) for x in got]
                out.write(b"".join(got))
            nulls.append(np.asarray(ks.is_null()))
            keys.append(np.asarray(ks.fill_null(0)))
        if out is None:
            return
        out.close()
        store.move(own, path)
        k, z, n = np.concatenate(keys), np.concatenate(nulls), np.array(lengths, "<u8")
        _put(f"{folder}/shard-{shard:06d}.mph", [pack_index(k, z, n, len(end))])
        real = k[~z]
        low, high = (int(real.min()), int(real.max())) if len(real) else (None, None)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), *(pa.array([v], pa.int64()) for v in (len(k), int(n.sum()), low, high))],
            ["shard", "rows", "ids", "low", "high"],
        )

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    order = (F.col("k").asc_nulls_first(), "h", "n")
    numbered = rows.select("k", "t", F.xxhash64("t").alias("h"), F.monotonically_increasing_id().alias("n"))
    ordered = numbered.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("k", "t")
    manifest = ordered.mapInArrow(run, _MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every row from the files: doc_id, start, n_tokens, ids_crc32.

    The driver sees one manifest row for each shard, to number the shards'
    first ids.  Each key goes through its shard's index, and the slice found
    there is what is summed, so a wrong slot would show.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    shards, start = [], 0
    for r in manifest.orderBy("shard").toLocalIterator():
        shards.append((r["shard"], start))
        start += r["ids"]
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                index = ShardIndex(_get(f"{folder}/shard-{shard:06d}.mph"))
                rows, lengths = len(index.row_keys), index.row_lengths.astype(np.int64)
                at = np.cumsum(lengths) - lengths
                # through the index where a key has its one row, else by the rows' order
                real = ~index.row_nulls
                if index.hash.n:
                    keys = index.row_keys[real]
                    slot = index.hash.slots(keys)
                    if (index.prints[slot] != marks(keys)).any():
                        raise ValueError(f"shard {shard}: an index slot holds another key")
                    once = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
                    where = np.flatnonzero(real)[once]
                    at[where], lengths[where] = index.offsets[slot[once]], index.lengths[slot[once]]
                store, path = _open(f"{folder}/shard-{shard:06d}.ids")
                sums = np.zeros(rows, np.int64)
                with store.open_input_file(path) as f:
                    i = 0
                    while i < rows:
                        j = i + 1
                        while j < rows and at[j] + lengths[j] - at[i] <= _SPILL:
                            j += 1
                        f.seek(int(at[i]) * index.width)
                        part = memoryview(wide(f.read(int(at[j - 1] + lengths[j - 1] - at[i]) * index.width), index.kind))
                        for r in range(i, j):
                            o = int(at[r] - at[i]) * 4
                            sums[r] = zlib.crc32(part[o : o + int(lengths[r]) * 4])
                        i = j
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index.row_keys, mask=index.row_nulls), pa.array(first + at), pa.array(lengths), pa.array(sums)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    todo = spark.createDataFrame(shards, "shard int, first long").repartition(len(shards))
    return todo.mapInArrow(run, out)


class TokenIndex:
    """Keyed access from one process."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").where("low IS NOT NULL").orderBy("shard")
        self.folder, self.shards = folder, [(r["low"], r["high"], r["shard"]) for r in rows.toLocalIterator()]
        self.highs = [x[1] for x in self.shards]
        self.open: dict[int, ShardIndex] = {}

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a key's document, or None."""
        at = bisect_left(self.highs, key)  # the first shard that ends at the key or after it
        if at == len(self.shards) or key < self.shards[at][0]:
            return None
        shard = self.shards[at][2]
        if shard not in self.open:
            self.open[shard] = ShardIndex(_get(f"{self.folder}/shard-{shard:06d}.mph"))
        found = self.open[shard].find(key)
        if found is None:
            return None
        index = self.open[shard]
        raw = _get(f"{self.folder}/shard-{shard:06d}.ids", found[0] * index.width, found[1] * index.width)
        return np.frombuffer(raw, index.kind).astype("<u4")


#: Characters and rows of a shard, about; its index is held whole by one task.
SHARD_CHARS, SHARD_ROWS = 256_000_000, 500_000


def shard_count(docs: DataFrame, text: str = "text") -> int:
    """By volume, and at least the session's number of shuffle partitions."""
    chars, rows = docs.agg(F.sum(F.length(text)), F.count("*")).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, -(-(chars or 0) // SHARD_CHARS), -(-rows // SHARD_ROWS))


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the shards to a fresh folder of the shared folder and read them back."""
    spark = docs.sparkSession
    folder = Workspace(spark, "token-index").path("shards")
    write(docs, folder, vocabulary, end_id, shard_count(docs))
    return read(spark, folder)
