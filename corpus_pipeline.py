"""From documents to token ids: quality, near duplicates, repeated passages, source mix, SentencePiece.

Each stage reads the table that the stage before wrote, and works on all of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import mixing, ngram_join, pieces, quality, suffix_dedup
from assaykit.llm.queries import model_path, read
from assaykit.llm.textio import among, cut, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MOST_BROADCAST_IDS = 200_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees score 0.5 or more."""
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of near duplicates; of its rows that share the id, each text once."""
    found = ngram_join.jaccard_components(docs)
    gone = cut(found.filter("component_id <> doc_id").select("doc_id").distinct())
    docs = docs.select(*COLUMNS)
    if gone.count() <= MOST_BROADCAST_IDS:
        left = docs.join(F.broadcast(gone), "doc_id", "left_anti")
    else:  # only documents that may go meet the list; null ids are of none
        some = F.coalesce(among(gone)(F.col("doc_id").cast("long")), F.lit(False))
        left = docs.filter(~some).unionByName(docs.filter(some).join(gone.hint("merge"), "doc_id", "left_anti"))
    twice = cut(docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if twice.isEmpty():
        return left.select(*COLUMNS)
    once = left.join(twice, "doc_id", "left_anti").select(*COLUMNS)
    return once.unionByName(left.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(*[F.min(c).alias(c) for c in COLUMNS[2:]]).select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of over 50 words (and any string of 400 bytes) that also come elsewhere; a text may become empty."""
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), as_text=True, span=suffix_dedup.PASSAGE_SPAN, least_words=suffix_dedup.PASSAGE_WORDS)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, one row each time, in the order of its shards; the last of a source may be cut."""
    mix = mixing.in_shard_order(mixing.mix_sources(docs.select(*COLUMNS)).withColumn("text", mixing.cut_text()))
    return mix.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text").cast("long"), F.lit(0)).alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the parity of both libraries, and whether the ids decode to the text again."""
    out = pieces.encode_texts(docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")), model_path(), decoded=True)
    return out.select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", "ids", "parity", "round_trip")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

#: No SQL expresses the classifier; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
