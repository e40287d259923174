"""Sources: where a stream's records come from.

Every source gives a DataFrame with an order.  Files read once are bounded
tables; files read continuously, and lists that run forever, are streaming
DataFrames.  Services that need a client of their own (queues, shard streams,
change feeds) go through an adapter that is registered by name, as none is
bundled here.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stream import Stream
from ..plans.work import shared_folder
from .formats import Format, JsonFormat


class Source(Protocol):
    def stream(self, spark: SparkSession) -> Stream: ...


@dataclass(frozen=True)
class ListSource:
    """Given records, in the order given; with ``run_forever`` as a stream that then idles."""

    rows: list[tuple]
    schema: str
    run_forever: bool = False

    def stream(self, spark: SparkSession) -> Stream:
        listed = Stream.of_list(spark, self.rows, self.schema)
        if not self.run_forever:
            return listed
        folder = f"{shared_folder(spark)}/list-{uuid.uuid4().hex}"
        listed.df.write.parquet(folder)
        df = spark.readStream.schema(listed.df.schema).parquet(folder)
        return Stream(df, listed.columns, listed.order)


@dataclass(frozen=True)
class DelayedListSource:
    """Records with pauses between them: ``steps`` of (milliseconds after the one before, record).

    The time that a record would arrive at becomes the field ``arrival`` (a
    time that starts at the epoch), so a bounded run sees the same order and
    the same event times without waiting.
    """

    steps: list[tuple[int, tuple]]
    schema: str

    def stream(self, spark: SparkSession) -> Stream:
        at, rows = 0, []
        for pause, r in self.steps:
            at += pause
            rows.append((*r, at))
        s = Stream.of_list(spark, rows, f"{self.schema}, _ms bigint")
        names = [c for c in s.columns if c != "_ms"]
        df = s.df.select(*names, F.timestamp_millis("_ms").alias("arrival"), *s.order)
        return Stream(df, [*names, "arrival"], s.order)


@dataclass(frozen=True)
class FileSource:
    """Files under a path of any file system that Spark reads.

    ``order_by``: the columns that order the records; without them the order
    is that of the files and of the lines in them.  ``continuous`` polls for
    new files (see ``POLL``).
    """

    path: str
    schema: str
    format: Format = field(default_factory=JsonFormat)
    order_by: tuple[str, ...] = ()
    continuous: bool = False

    POLL = "5 seconds"

    def stream(self, spark: SparkSession) -> Stream:
        df = self.format.read(spark.readStream if self.continuous else spark.read, self.schema, self.path)
        if self.order_by:
            return Stream.from_df(df, self.order_by)
        if self.continuous:
            raise ValueError("records that arrive over time need order_by")
        df = df.withColumn("_o0", F.monotonically_increasing_id())
        return Stream(df, [c for c in df.columns if c != "_o0"], ["_o0"])


def object_store_source(bucket: str, key: str, schema: str, **more: Any) -> FileSource:
    """Files of an object store."""
    return FileSource(f"s3a://{bucket.strip('/')}/{key.strip('/')}", schema, **more)


#: Adapters of services: name -> (spark, options) -> DataFrame.
ADAPTERS: dict[str, Callable[[SparkSession, dict[str, Any]], DataFrame]] = {}


def register_adapter(name: str, read: Callable[[SparkSession, dict[str, Any]], DataFrame]) -> None:
    ADAPTERS[name] = read


@dataclass(frozen=True)
class ServiceSource:
    """A source outside of Spark, by the name of its adapter: shard-stream, queue, table-changes.

    The adapter gives a DataFrame with a column ``value`` of JSON text; with
    ``image`` set, the value is a change record of which only the field
    ``NewImage`` counts, its attributes typed as {"S": ..}, {"N": ..}, ...
    """

    kind: str
    schema: str
    order_by: tuple[str, ...]
    options: dict[str, Any] = field(default_factory=dict)
    image: bool = False

    def stream(self, spark: SparkSession) -> Stream:
        if self.kind not in ADAPTERS:
            raise LookupError(f"no adapter is registered for {self.kind!r}; see register_adapter")
        raw = ADAPTERS[self.kind](spark, self.options)
        if self.image:
            kept = raw.select(F.get_json_object("value", "$.NewImage").alias("i")).where("i IS NOT NULL")

            @F.pandas_udf("string")
            def plain(images):  # noqa: ANN001, ANN202
                return images.map(plain_image)

            raw = kept.select(plain("i").alias("value"))
        df = raw.select(F.from_json("value", self.schema).alias("r")).select("r.*")
        return Stream.from_df(df, self.order_by)


def plain_image(text: str) -> str:
    """A change record's typed attributes as plain JSON."""
    import json

    def plain(v: dict) -> Any:
        ((kind, x),) = v.items()
        if kind == "N":
            return float(x) if any(c in x for c in ".eE") else int(x)
        if kind == "NULL":
            return None
        if kind == "L":
            return [plain(y) for y in x]
        if kind == "M":
            return {k: plain(y) for k, y in x.items()}
        return x

    return json.dumps({k: plain(v) for k, v in json.loads(text).items()})


@dataclass(frozen=True)
class PointerSource:
    """What another application's sink wrote, read as a source."""

    path: str
    order_by: tuple[str, ...]

    def stream(self, spark: SparkSession) -> Stream:
        return Stream.from_df(spark.read.parquet(self.path), self.order_by)


