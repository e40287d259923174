"""Sinks: where a stream's records go.

Each sink takes bounded and streaming streams alike; for a streaming one it
returns the running query.
"""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.stream import Stream
from .formats import CsvFormat, Format, JsonFormat

log = logging.getLogger("rivulet.sink")


class Sink(Protocol):
    def write(self, stream: Stream, **options: Any) -> StreamingQuery | None: ...


def _each_batch(stream: Stream, fn: Callable[[DataFrame], None], options: dict[str, Any]) -> StreamingQuery | None:
    df = stream.to_df(with_order=True)
    if not stream.streaming:
        fn(df.orderBy(*stream.order).select(*stream.columns))
        return None
    writer = df.writeStream.outputMode(options.get("mode", "append")).foreachBatch(lambda b, _: fn(b.orderBy(*stream.order).select(*stream.columns)))
    if "checkpoint" in options:
        writer = writer.option("checkpointLocation", options["checkpoint"])
    trigger = options.get("trigger", {"availableNow": True})
    return writer.trigger(**trigger).start()


@dataclass(frozen=True)
class ConsoleSink:
    rows: int = 20

    def write(self, stream: Stream, **options: Any) -> StreamingQuery | None:
        return _each_batch(stream, lambda df: df.show(self.rows, truncate=False), options)


@dataclass(frozen=True)
class LogSink:
    name: str = "records"

    def write(self, stream: Stream, **options: Any) -> StreamingQuery | None:
        def out(df: DataFrame) -> None:
            for r in df.toLocalIterator():
                log.info("%s: %s", self.name, r.asDict(recursive=True))

        return _each_batch(stream, out, options)


@dataclass(frozen=True)
class FileSink:
    """One file in arrival order, replaced at each write; meant for small results."""

    path: str
    format: Format = field(default_factory=JsonFormat)

    def write(self, stream: Stream, **options: Any) -> StreamingQuery | None:
        def out(df: DataFrame) -> None:
            shaped = self.format.shaped(df) if isinstance(self.format, CsvFormat) else df
            self.format.write(shaped, shaped.coalesce(1).write.mode("append" if stream.streaming else "overwrite"), self.path)

        return _each_batch(stream, out, options)


@dataclass(frozen=True)
class PartitionedSink:
    """Files of an object store or file system in folders by some columns."""

    path: str
    by: tuple[str, ...]
    format: Format = field(default_factory=JsonFormat)

    def write(self, stream: Stream, **options: Any) -> StreamingQuery | None:
        if stream.streaming:
            w = stream.to_df().writeStream.format(self.format.name).partitionBy(*self.by).option("path", self.path)
            return w.option("checkpointLocation", options["checkpoint"]).trigger(**options.get("trigger", {"availableNow": True})).start()
        df = stream.to_df()
        # one task for each folder and size class would make a hot folder slow; rows are rebalanced instead
        balanced = df.hint("rebalance", *self.by)
        self.format.write(balanced, balanced.write.mode("overwrite").partitionBy(*self.by), self.path)
        return None


class MemorySink:
    """Records kept in this process by sink id, each with a number from 1."""

    _all: dict[str, list[tuple[int, dict]]] = {}
    _lock = threading.Lock()

    def __init__(self, sink_id: str) -> None:
        self.sink_id = sink_id
        with self._lock:
            self._all.setdefault(sink_id, [])

    def write(self, stream: Stream, **options: Any) -> StreamingQuery | None:
        def out(df: DataFrame) -> None:
            for r in df.toLocalIterator():
                with self._lock:
                    kept = self._all[self.sink_id]
                    kept.append((len(kept) + 1, r.asDict(recursive=True)))

        return _each_batch(stream, out, options)

    @property
    def records(self) -> list[dict]:
        with self._lock:
            return [r for _, r in self._all[self.sink_id]]

    def clear(self) -> None:
        with self._lock:
            self._all[self.sink_id].clear()

    def wait_for(self, count: int, seconds: float = 10) -> list[dict]:
        end = time.monotonic() + seconds
        while len(self.records) < count:
            if time.monotonic() > end:
                raise TimeoutError(f"{len(self.records)} of {count} records")
            time.sleep(0.05)
        return self.records


#: Writers of services: name -> (records as JSON text, options).  Called on executors, part by part.
WRITERS: dict[str, Callable[[list[str], dict[str, Any]], None]] = {}


def register_writer(name: str, write: Callable[[list[str], dict[str, Any]], None]) -> None:
    WRITERS[name] = write


@dataclass(frozen=True)
class ServiceSink:
    """A sink outside of Spark (queue, shard stream, table), by the name of its writer."""

    kind: str
    options: dict[str, Any] = field(default_factory=dict)
    typed: bool = False  # attributes as {"S": ..}, {"N": ..}, ..., for a key-value table
    batch: int = 500

    def write(self, stream: Stream, **options: Any) -> StreamingQuery | None:
        if self.kind not in WRITERS:
            raise LookupError(f"no writer is registered for {self.kind!r}; see register_writer")
        put, settings, size, typed = WRITERS[self.kind], self.options, self.batch, self.typed

        def part(rows) -> None:  # noqa: ANN001
            held: list[str] = []
            for r in rows:
                record = r.asDict(recursive=True)
                held.append(json.dumps(typed_image(record) if typed else record, default=str))
                if len(held) >= size:
                    put(held, settings)
                    held = []
            if held:
                put(held, settings)

        return _each_batch(stream, lambda df: df.foreachPartition(part), options)


def typed_image(record: dict) -> dict:
    def typed(v: Any) -> dict:
        if v is None:
            return {"NULL": True}
        if isinstance(v, bool):
            return {"BOOL": v}
        if isinstance(v, (int, float)):
            return {"N": repr(v)}
        if isinstance(v, (list, tuple)):
            return {"L": [typed(x) for x in v]}
        if isinstance(v, dict):
            return {"M": {k: typed(x) for k, x in v.items()}}
        return {"S": str(v)}

    return {k: typed(v) for k, v in record.items()}
