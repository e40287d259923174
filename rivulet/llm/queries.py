"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, brown, decontam, html_extract, oracles, packing, quality, secrets, simhash, token_index, toxicity
from .common import Workspace, bound_batches, held_out
from .tokens import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~held_out("doc_id", 4, 2))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
    )


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op3_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = Workspace(spark, "secrets").keep(secrets.keyed(_table(spark, sf_dir, "documents")), "parts")
    return secrets.with_weak(parts).select(
        F.col("id").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(spark, _table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~held_out("doc_id", 3, 1))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"),
    )


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": _bounded(op1_toxicity),
    "op2_token_index": _bounded(op2_token_index),
    "op3_brown": _bounded(op3_brown),
    "op4_packing": _bounded(op4_packing),
    "op5_html": _bounded(op5_html),
    "op6_secrets": _bounded(op6_secrets),
    "op7_decontamination": _bounded(op7_decontamination),
    "op8_forest": _bounded(op8_forest),
    "op9_simhash": _bounded(op9_simhash),
    "op10_quality": _bounded(op10_quality),
    "pipeline": _bounded(_pipeline),
}

ORACLE_SQL: dict[str, str] = oracles.SQL
