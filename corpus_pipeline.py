"""A corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import decontam, packing, secrets, simhash, toxicity
from rivulet.llm.common import Workspace, bound_batches, held_out
from rivulet.llm.tokens import vocabulary

#: Documents with a toxicity of this or more are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~held_out("doc_id", 4, 2))
    return toxicity.score(docs, model).where(F.col("toxicity") < TOXIC).drop("toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays, once; rows without an id stay."""
    bound_batches(spark)
    ws = Workspace(spark, "dedup")
    classes = ws.keep(simhash.near_classes(spark, docs), "classes")
    later = ws.keep(classes.where("doc_id <> component_id").select("doc_id").distinct(), "later")
    kept = docs.join(later, "doc_id", "left_anti")
    # a second row of the same id is a copy too; only such rows are gathered
    twice = ws.keep(classes.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = Workspace(spark, "leaks").keep(decontam.matches(docs, items).select("doc_id").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced by a mark in the text; n_chars follows."""
    ws = Workspace(spark, "redact")
    parts = ws.keep(secrets.keyed(docs), "parts")
    spans = secrets.with_weak(parts).where(F.size("spans") > 0).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("spans").alias("__spans"))
    found = ws.keep(spans.dropDuplicates(["__id", "__h"]), "found")
    same = (F.xxhash64(docs["doc_id"], docs["text"]) == found["__h"]) & docs["doc_id"].eqNullSafe(found["__id"])
    # the new text gets a name of its own first: an alias "text" could be taken for the old one in the same select
    new = F.when(F.col("__spans").isNotNull(), secrets.redact(F.col("text"), F.col("__spans"))).otherwise(F.col("text"))
    hit = docs.join(found, same, "left").withColumn("__text", new)
    size = F.when(F.col("__spans").isNotNull(), F.length("__text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    made = {"text": F.col("__text"), "n_chars": size}
    return hit.select(*(made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
    return docs
