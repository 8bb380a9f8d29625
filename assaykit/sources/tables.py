"""Readers and the canonical views that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unit, index, label, score, decision``: labelled documents scored by their length."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("unit"), F.col("source").alias("scenario"), "n_chars")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    score = F.least(F.lit(1.0), F.col("n_chars") / 20000.0)
    return docs.join(labels, "doc_id").select("unit", "scenario", F.col("doc_id").alias("index"), "label", "toxic", score.alias("score"), (F.col("n_chars") >= 1000).cast("int").alias("decision"))


def second_predictions(preds: DataFrame) -> DataFrame:
    """Another scorer of the same rows, from their index."""
    return preds.withColumn("score", F.pmod("index", F.lit(97)) / 97.0).withColumn("decision", (F.pmod("index", F.lit(97)) >= 40).cast("int"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records: one unit of one submission a row, some failed."""
    o = read(spark, sf_dir, "orders")
    failed = F.pmod("o_orderkey", F.lit(53)) == 0
    return o.select(
        (F.col("o_custkey") % 20).alias("team"), F.col("o_orderpriority").alias("notebook"), F.col("o_orderdate").alias("submitted_at"), (F.col("o_orderkey") % 7).alias("unit"),
        F.when(~failed, F.col("o_totalprice") / 600000).alias("metric"), (~failed).alias("ok"), F.col("o_orderkey").alias("record"),
    )


def members(preds: DataFrame) -> DataFrame:
    """Three scorers of the same rows in long form: ``index, label, member, decision``."""
    one = preds.select("index", "label", F.lit(0).alias("member"), "decision")
    two = second_predictions(preds).select("index", "label", F.lit(1).alias("member"), "decision")
    return one.unionByName(two).unionByName(preds.select("index", "label", F.lit(2).alias("member"), (F.pmod("index", F.lit(3)) == 0).cast("int").alias("decision")))
