"""Applications: named streams with sources, sinks, lineage sinks, metrics and state stores."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .plans.stream import Stream
from .sources import formats, sinks, sources
from .sources.sinks import MemorySink, Sink
from .sources.sources import Source

#: State store choices for streaming queries.
STATE_STORES = {
    "default": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


@dataclass(frozen=True)
class Histogram:
    """A metric: quantiles of a column."""

    column: str
    quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)
    accuracy: int = 1000

    def of(self, df: DataFrame) -> DataFrame:
        return df.agg(F.percentile_approx(self.column, list(self.quantiles), self.accuracy).alias("quantiles"), F.count("*").alias("records"))


@dataclass
class Application:
    """``build`` turns the sources' streams, by name, into named output streams."""

    name: str
    build: Callable[[dict[str, Stream]], dict[str, Stream]]
    version: str = "0"
    sources: dict[str, Source] = field(default_factory=dict)
    sinks: dict[str, list[Sink]] = field(default_factory=dict)
    lineage: dict[str, Callable[[dict[str, Stream]], DataFrame]] = field(default_factory=dict)
    metrics: dict[str, list[Histogram]] = field(default_factory=dict)
    state_store: str = "default"

    def set_source(self, stream: str, source: Source) -> Application:
        self.sources[stream] = source
        return self

    def add_sink(self, stream: str, sink: Sink) -> Application:
        self.sinks.setdefault(stream, []).append(sink)
        return self

    def to_json(self) -> str:
        """The application as text; its functions are named, so they must be importable."""
        made = {"name": self.name, "version": self.version, "state_store": self.state_store, "build": _name_of(self.build)}
        made["sources"] = {k: _described(v) for k, v in self.sources.items()}
        made["lineage"] = {k: _name_of(v) for k, v in self.lineage.items()}
        for part in ("sinks", "metrics"):
            made[part] = {k: [_described(x) for x in v] for k, v in getattr(self, part).items()}
        return json.dumps(made, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Application:
        given = json.loads(text)
        app = cls(given["name"], _named(given["build"]), given["version"], state_store=given["state_store"])
        app.sources = {k: _revived(v) for k, v in given["sources"].items()}
        app.lineage = {k: _named(v) for k, v in given["lineage"].items()}
        app.sinks, app.metrics = ({k: [_revived(x) for x in v] for k, v in given[part].items()} for part in ("sinks", "metrics"))
        return app

    def run(self, spark: SparkSession, **options: Any) -> Run:
        """Start every sink; bounded streams are done when this returns."""
        if self.state_store != "default":
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORES[self.state_store])
        given = {name: s.stream(spark).with_name(name) for name, s in self.sources.items()}
        made = {**given, **self.build(given)}
        if missing := set(self.sinks) - set(made):
            raise LookupError(f"sinks of streams that do not exist: {sorted(missing)}")
        queries: list[StreamingQuery] = []
        for name, sinks in self.sinks.items():
            # a stream with several sinks is computed once
            stream = made[name]
            shared = len(sinks) > 1 and not stream.streaming
            if shared:
                stream.df.persist()
            for i, sink in enumerate(sinks):
                own = dict(options)
                if "checkpoint" in own:
                    own["checkpoint"] = f"{own['checkpoint']}/{name}-{i}"
                if (q := sink.write(stream, **own)) is not None:
                    queries.append(q)
            if shared:
                stream.df.unpersist()
        return Run(self, made, queries)


@dataclass
class Run:
    app: Application
    streams: dict[str, Stream]
    queries: list[StreamingQuery]

    def wait(self, seconds: float | None = None) -> None:
        for q in self.queries:
            q.awaitTermination(seconds)

    def metric(self, stream: str) -> list[DataFrame]:
        return [m.of(self.streams[stream].to_df()) for m in self.app.metrics.get(stream, [])]

    def lineage(self, name: str) -> DataFrame:
        return self.app.lineage[name](self.streams)


def _name_of(fn: Callable) -> str:
    name = f"{fn.__module__}:{fn.__qualname__}"
    try:
        found = _named(name)
    except (ImportError, AttributeError):
        found = None
    if found is not fn:
        raise ValueError(f"{name} cannot be found again by its name")
    return name


def _named(name: str) -> Any:
    module, _, path = name.partition(":")
    found = importlib.import_module(module)
    for part in path.split("."):
        found = getattr(found, part)
    return found


def _described(x: Any) -> Any:
    """Sources, sinks, formats and metrics as plain values; ``type`` names the class, ``tuple`` holds a tuple's members."""
    if isinstance(x, MemorySink):
        return {"type": "MemorySink", "sink_id": x.sink_id}
    if is_dataclass(x):
        return {"type": type(x).__name__, **{f.name: _described(getattr(x, f.name)) for f in fields(x)}}
    if isinstance(x, tuple):
        return {"tuple": [_described(y) for y in x]}
    if isinstance(x, list):
        return [_described(y) for y in x]
    return {"map": {k: _described(v) for k, v in x.items()}} if isinstance(x, dict) else x


def _revived(x: Any) -> Any:
    if isinstance(x, list):
        return [_revived(y) for y in x]
    if not isinstance(x, dict):
        return x
    if "tuple" in x:
        return tuple(_revived(y) for y in x["tuple"])
    if "map" in x:
        return {k: _revived(v) for k, v in x["map"].items()}
    for place in (sources, sinks, formats):
        if (kind := getattr(place, x["type"], None)) is not None:
            break
    else:
        kind = {"Histogram": Histogram}[x["type"]]
    return kind(**{k: _revived(v) for k, v in x.items() if k != "type"})


def observed(stream: Stream, name: str) -> Stream:
    """The stream with a counter of its records that listeners and ``df.observe`` report."""
    return stream._with(stream.df.observe(name, F.count(F.lit(1)).alias("records")), stream.columns)


def main(args: list[str] | None = None) -> int:
    """``python -m rivulet run module:function``, where the function gives an Application, or ``run file.json``."""
    p = argparse.ArgumentParser(prog="rivulet")
    p.add_argument("command", choices=["run"])
    p.add_argument("application", help="module:function, or a file that Application.to_json made")
    p.add_argument("--master", default=None)
    p.add_argument("--checkpoint", default=None)
    a = p.parse_args(args)
    if a.application.endswith(".json"):
        app = Application.from_json(Path(a.application).read_text())
    else:
        app = _named(a.application)()
    builder = SparkSession.builder.appName(app.name).config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    app.run(spark, **({"checkpoint": a.checkpoint} if a.checkpoint else {})).wait()
    return 0
