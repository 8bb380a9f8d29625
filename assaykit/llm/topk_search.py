"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a row of terms (components) with integer weights. For a block of
queries a dense score array is held against a block of candidates; for each term
the candidates' postings, times the weights of the queries that have the term, are
scattered into it. The k best of a block come by partition selection and are
merged with those of the blocks before; tasks are merged by query at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textio import cut

QUERY_BLOCK, CANDIDATE_BLOCK = 16_384, 1024


def quantised(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, w``: components as floor(scale * x); vectors that are null or hold a null, NaN or infinity are left out."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & whole).select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("w"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of unequal length are padded with zero weights."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width), np.int64)
    if len(flat):
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores, one term after another; exact in integers (in doubles where all sums stay below 2**53)."""
    terms = min(queries.shape[1], candidates.shape[1])
    bound = float(np.abs(queries[:, :terms]).max(initial=0)) * float(np.abs(candidates[:, :terms]).max(initial=0)) * max(1, terms)
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    scores = np.zeros((len(queries), len(candidates)), kind)
    q, c = queries[:, :terms].astype(kind), np.ascontiguousarray(candidates[:, :terms].T).astype(kind)
    for t in range(terms):
        has, posted = np.flatnonzero(q[:, t]), np.flatnonzero(c[t])
        if len(has) == len(q) and len(posted) == c.shape[1]:
            scores += q[:, t, None] * c[t]
        elif len(has) and len(posted):
            scores[np.ix_(has, posted)] += q[has, t, None] * c[t, posted]
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, id and score of the k highest of each row (ties to the smaller id), its own id left out."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    # One key for score and place: all keys differ, so partition selection has no ties to break.
    keys = scores[:, order].astype(np.int64) * len(ids) + (len(ids) - 1 - np.arange(len(ids)))
    low = np.iinfo(np.int64).min
    left, right = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
    for row in np.flatnonzero(right > left):
        keys[row, left[row] : right[row]] = low
    top = min(k, len(ids))
    part = np.argpartition(keys, len(ids) - top, axis=1)[:, len(ids) - top :] if top < len(ids) else np.broadcast_to(np.arange(len(ids)), keys.shape)
    rows = np.repeat(np.arange(len(scores)), top)
    cols = part.ravel()
    kept = keys[rows, cols] != low
    rows, cols = rows[kept], cols[kept]
    return rows, ids[cols], scores[:, order][rows, cols].astype(np.int64)


def top_k_search(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Each query's k best by integer inner product: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with another id; ties go to
    the smaller id; fewer candidates give fewer rows. Vectors that are null or hold null or non-finite
    components, and null ids, take no part; an empty vector scores 0. Of a repeated id among the queries one row
    counts; a repeated candidate counts once for each row of other ids (ties beyond that are by id alone). Queries
    come in blocks of ``QUERY_BLOCK``, which pass through the driver one at a time: a block is sent to the tasks, its k best
    are written, and it is freed, so neither the driver nor what is broadcast grows with the table. Each candidate
    partition sends at most k rows a query. The table is read once a block.
    """
    rows = quantised(df, id_col, vector, scale)
    spark = df.sparkSession
    wanted = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts, block = [], []

    def flush():
        if block:
            ids = np.array([r["vec_id"] for r in block], np.int64)
            width = max(len(r["w"]) for r in block)
            weights = np.zeros((len(ids), width), np.int64)
            for i, r in enumerate(block):
                weights[i, : len(r["w"])] = r["w"]
            sent = spark.sparkContext.broadcast((ids, weights))
            found = rows.mapInArrow(lambda batches: _search(batches, sent.value, k), "query_id long, vec_id long, score long")
            parts.append(cut(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
            sent.destroy()
            block.clear()

    for row in wanted.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            flush()
    flush()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return parts[0] if len(parts) == 1 else spark.read.schema(parts[0].schema).parquet(*[f for part in parts for f in part.inputFiles()])


def _search(batches, sent, k: int):
    own, queries = sent
    held = tuple(np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATE_BLOCK):
            part = batch.slice(at, CANDIDATE_BLOCK)
            ids, weights = part.column(0).to_numpy(), _matrix(part.column(1))
            for q in range(0, len(own), 256):
                r, i, s = best(accumulate(queries[q : q + 256], weights), ids, own[q : q + 256], k)
                held = tuple(np.concatenate(x) for x in zip(held, (r + q, i, s), strict=True))
        order = np.lexsort((held[1], -held[2], held[0]))
        held = tuple(x[order] for x in held)
        first = np.searchsorted(held[0], held[0])
        kept = np.arange(len(first)) - first < k
        held = tuple(x[kept] for x in held)
    yield pa.RecordBatch.from_arrays([pa.array(own[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "vec_id", "score"])
