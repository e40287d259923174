"""Questions about where records came from.

A lineage table has one row for each output record: subject_id and the array
``sources`` of (stream, record).  ``edges`` flattens it; the walks below go
one generation a round over those edges, as joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.work import written


def edges(lineage: DataFrame, stream: str) -> DataFrame:
    """(stream, subject, from_stream, source) of a lineage table of the stream named."""
    one = lineage.select(F.lit(stream).alias("stream"), F.col("subject_id").alias("subject"), F.explode("sources").alias("s"))
    return one.select("stream", "subject", F.col("s.stream").alias("from_stream"), F.col("s.record").alias("source"))


def has_lineage(records: DataFrame, links: DataFrame, key: str, stream: str) -> DataFrame:
    """``records`` that have a row in ``links``."""
    own = links.where(F.col("stream") == stream).select(F.col("subject").alias("_s")).distinct()
    return records.join(own, F.col(key).cast("string") == F.col("_s"), "left_semi")


def immediate_descendants(links: DataFrame, stream: str, source: str) -> DataFrame:
    return links.where((F.col("from_stream") == stream) & (F.col("source") == source)).select("stream", "subject").distinct()


def ancestors(links: DataFrame, stream: str, subject: str) -> DataFrame:
    """(stream, record, generation) of everything that a record comes from."""
    spark = links.sparkSession
    found = spark.createDataFrame([(stream, subject, 0)], "stream string, record string, generation int")
    front, turn = found, 0
    while True:
        turn += 1
        back = links.join(front, (links["stream"] == front["stream"]) & (links["subject"] == front["record"])).select(
            F.col("from_stream").alias("stream"), F.col("source").alias("record"), F.lit(turn).alias("generation")
        )
        front = written(back.distinct().join(found.select("stream", "record"), ["stream", "record"], "left_anti"), "lineage")
        if front.isEmpty():
            return found.where("generation > 0")
        found = found.unionByName(front)


def is_descended_from(links: DataFrame, subject: tuple[str, str], source: tuple[str, str]) -> bool:
    up = ancestors(links, *subject)
    return not up.where((F.col("stream") == source[0]) & (F.col("record") == source[1])).isEmpty()


def first_upstream(links: DataFrame, subject: tuple[str, str], stream: str) -> str | None:
    """The nearest record of ``stream`` that a record comes from."""
    row = ancestors(links, *subject).where(F.col("stream") == stream).orderBy("generation", "record").first()
    return row["record"] if row else None
