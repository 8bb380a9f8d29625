"""A stored inverted index with block maxima, and BM25 search that reads only blocks which can reach the k-th score.

Documents are dealt to blocks of about ``DOCS_A_BLOCK`` by a hash of their key, the same for all words. The index holds one row for
each field, word and block: the documents with their part of the score (without the word's weight), and the largest part. The sum
of a query's weighted largest parts bounds the score of every document of a block. The most promising blocks of each query are
scored first; their k-th best score is a floor, and blocks whose bound lies below it are never opened.
"""

from __future__ import annotations

import dataclasses
import json
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrowtext import cut, shared_dir, small_batches, tidy
from ..functions.scalar import normalised

K1, B = 1.2, 0.75
DOCS_A_BLOCK = 64
DOCS_A_BUCKET = 50_000
SLICES = 4  # files of a bucket at least, so that a word of all documents is in several
FIRST_BLOCKS = 8
_MARGIN = 2e-6  # scores are rounded to six digits
_WORD = re.compile("[a-z0-9]+")
_WRITTEN = "field string, term string, block long, n long, top double"


@dataclasses.dataclass
class TextIndex:
    """``blocks`` (field, term, block, n, top, hits (key, part)) in buckets of words, and each field's number of documents."""

    blocks: DataFrame
    counts: dict[str, int]
    n_buckets: int
    path: str


def words(text) -> F.Column:
    return F.filter(F.split(normalised(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def _word_lists(texts: pa.Array) -> list[list[str]]:
    return [_WORD.findall(t.lower()) if t else [] for t in texts.to_pylist()]


def _sizes(batches):
    """``f, texts, filled, size``: of each field the texts that are not null, those with words, and the words."""
    for batch in batches:
        lists = [_word_lists(c) for c in batch.columns]
        columns = [
            pa.array(range(len(lists)), pa.int32()),
            pa.array([len(c) - c.null_count for c in batch.columns], pa.int64()),
            pa.array([sum(map(bool, x)) for x in lists], pa.int64()),
            pa.array([sum(map(len, x)) for x in lists], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["f", "texts", "filled", "size"])


def _inverted(batches, names: list[str], means: list[float], n_buckets: int):
    """Rows come sorted by block; the lists of a block are held until its last document."""
    held, at, keys = {}, None, None

    def flush():
        rows = list(held.items())
        for k in range(0, len(rows), 20_000):
            part = rows[k : k + 20_000]
            size = np.array([len(v[0]) for _, v in part])
            flat = pa.StructArray.from_arrays([keys.take(pa.array(np.concatenate([v[0] for _, v in part]))), pa.array(np.concatenate([v[1] for _, v in part]))], names=["key", "part"])
            columns = [
                pa.array([names[f] for (f, _), _ in part]),
                pa.array([w for (_, w), _ in part]),
                pa.array(np.full(len(part), at)),
                pa.array(size),
                pa.array([max(v[1]) for _, v in part]),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), flat),
                pa.array([zlib.crc32(w.encode()) % n_buckets for (_, w), _ in part], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["field", "term", "block", "n", "top", "hits", "bucket"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.diff(blocks)) + 1
        for a, z in zip([0, *edges], [*edges, len(blocks)], strict=True):
            if blocks[a] != at:
                yield from flush()
                held, at, keys = {}, blocks[a], batch.column(1).slice(0, 0)
            base = len(keys)
            keys = pa.concat_arrays([keys, batch.column(1).slice(a, z - a)])
            for f, mean in enumerate(means):
                for i, found in enumerate(_word_lists(batch.column(2 + f).slice(a, z - a))):
                    damped = K1 * (1 - B + B * len(found) / mean) if found else 0.0
                    for word, tf in Counter(found).items():
                        places, parts = held.setdefault((f, word), ([], []))
                        places.append(base + i)
                        parts.append(tf * (K1 + 1) / (tf + damped))
    yield from flush()


def build_index(docs: DataFrame, key: str, fields: list[str], path: str | None = None, empty: bool = True) -> TextIndex:
    """Write the index of some fields of ``docs`` to ``path`` (a new folder of the shared one, if None).

    Null texts and texts without words have no postings; with ``empty`` they count in the number of documents and in the mean length, without
    it null texts do not count and the mean is that of texts with words. A document's key must be its own; null keys are left out.
    Texts are shuffled once, to their block, whose lists one task makes in memory; the lists are shuffled once, to buckets of
    words. Blocks and buckets hold a bounded part of the documents, so a word that all documents hold is no task of its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    sizes = docs.drop("key").mapInArrow(tidy(_sizes), "f int, texts long, filled long, size long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("texts", "filled", "size")])
    n_docs = docs.count()
    got = {r["f"]: r for r in sizes.collect()}
    counts, means = {}, []
    for i, f in enumerate(fields):
        texts, filled, size = (got[i][1:] if i in got else (0, 0, 0))
        counts[f] = n_docs if empty else texts
        means.append(size / max(1, n_docs if empty else filled) or 1.0)
    n_blocks = max(1, -(-n_docs // DOCS_A_BLOCK))
    n_buckets = max(8, n_docs // DOCS_A_BUCKET)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).select("block", "key", *[f"f{i}" for i in range(len(fields))])
    kind = dict(dealt.dtypes)["key"]
    schema = f"{_WRITTEN}, hits array<struct<key: {kind}, part: double>>, bucket int"
    rows = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(lambda batches: _inverted(batches, fields, means, n_buckets)), schema)
    path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    rows.repartition("bucket", F.pmod("block", F.lit(SLICES))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/blocks")
    spark.createDataFrame([(json.dumps(counts),)], "counts string").coalesce(1).write.parquet(f"{path}/counts")
    spark.createDataFrame([(n_buckets,)], "n int").coalesce(1).write.parquet(f"{path}/buckets")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    """An index that was written before, in this session or another."""
    counts = json.loads(spark.read.parquet(f"{path}/counts").first()[0])
    n_buckets = spark.read.parquet(f"{path}/buckets").first()[0]
    try:
        blocks = spark.read.parquet(f"{path}/blocks")
    except AnalysisException:  # an index without words has no files
        blocks = spark.createDataFrame([], f"{_WRITTEN}, hits array<struct<key: long, part: double>>, bucket int")
    return TextIndex(blocks, counts, n_buckets, path)


def _weighted_words(index: TextIndex, queries: DataFrame, query_key: str, text: str, weights: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """``q, field, term, w`` (field weight times inverse document frequency), and the blocks that hold any of the words."""
    wanted = queries.select(F.col(query_key).alias("q"), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(index.n_buckets)).cast("int")
    names = cut(wanted.select("term").distinct().withColumn("bucket", bucket))
    held = cut(index.blocks.filter(F.col("field").isin(*weights)).join(names, ["bucket", "term"]).drop("bucket"))
    number, weight = (F.create_map(*[x for f in weights for x in (F.lit(f), F.lit(float(d[f])))])[F.col("field")] for d in (index.counts, weights))
    df = held.groupBy("field", "term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (number - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return cut(wanted.join(df.withColumn("w", weight * idf).drop("df"), "term").select("q", "field", "term", "w")), held


def _scored(terms: DataFrame, held: DataFrame, pairs: DataFrame) -> DataFrame:
    """``q, key, score`` of all documents of some (q, block)."""
    asked = pairs.join(terms, "q").select("q", "field", "term", "block", "w")
    hits = asked.join(held.select("field", "term", "block", "hits"), ["field", "term", "block"]).select("q", "w", F.explode("hits").alias("h"))
    scored = hits.groupBy("q", F.col("h.key").alias("key")).agg(F.sum(F.col("w") * F.col("h.part")).alias("score"))
    return scored.withColumn("score", F.round("score", 6))


def plan_blocks(index: TextIndex, queries: DataFrame, query_key: str, text: str, weights: dict[str, float], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of the first blocks of each query; the (q, block) pairs opened after them; and all pairs with their bounds."""
    terms, held = _weighted_words(index, queries, query_key, text, weights)
    bounds = cut(terms.join(held.select("field", "term", "block", "top"), ["field", "term"]).groupBy("q", "block").agg(F.sum(F.col("w") * F.col("top")).alias("bound")))
    best = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= FIRST_BLOCKS).select("q", "block")
    early = cut(_scored(terms, held, first))
    kth = early.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))).filter(F.col("r") == k)
    left = bounds.join(first, ["q", "block"], "left_anti").join(kth.select("q", F.col("score").alias("floor")), "q", "left")
    later = cut(left.filter(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - _MARGIN)).select("q", "block"))
    return early.unionByName(_scored(terms, held, later)), later, bounds


def search(index: TextIndex, queries: DataFrame, query_key: str, text: str, weights: dict[str, float], k: int, key: str) -> DataFrame:
    """``query_key, key, score, rank``: the k best documents of each query by the weighted sum of the BM25 scores of their fields.

    A query holds any of its distinct words; scores are rounded to six digits, ties go to the smaller key. A query without
    words, or whose words no document holds, has no rows; a repeated query key is one query of all its words.
    """
    scored, _, _ = plan_blocks(index, queries, query_key, text, weights, k)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    out = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")
