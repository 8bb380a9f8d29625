"""Helpers shared by the operators: written cuts of the lineage, Arrow text access, vectorised words.

Texts are read from Arrow buffers as UTF-8 bytes in chunks of a few megabytes, so
that the memory of a Python worker is bounded by the chunk (or by one text if
that is longer), never by the partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 500_000
BATCH_ROWS = 1000
MOST_AMONG = 16_000_000  # ids of four bytes
FEW, PART = 20_000, 2_500  # rows of a few numbers that a join may send to all tasks, and of a small table that one task takes
#: The separators of words: space and the control characters 0x09 to 0x0D.
SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="assaykit-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_few(df: DataFrame, most: int, per: int = PART) -> DataFrame:
    """:func:`cut` of a frame that has at most ``most`` rows, in as many files as parts of ``per`` rows, or one a partition if those are fewer.

    A small table so takes a few tasks here and where it is read, however many partitions a shuffle has.
    """
    return cut(df.coalesce(max(1, -(-most // per))))


def met(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has at most so many rows: up to ``FEW`` are sent to all tasks, more are met by sort and merge."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def cut_parts(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """Write frames of one schema one after another to one folder, and read them as one."""
    path, schema = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}", None
    for part in parts:
        part.write.mode("append").parquet(path)
        schema = schema or part.schema
    return spark.read.schema(schema).parquet(path)


def short_hash(column: Column) -> Column:
    """32 bits of a hash."""
    return (F.xxhash64(column).bitwiseAND(F.lit(2**32 - 1)) - F.lit(2**31)).cast("int")


def short_hashes(ids: DataFrame, most: int | None = None):
    """The sorted :func:`short_hash` of ``ids`` (one column) as a broadcast, or None for more than ``MOST_AMONG``; ``most`` bounds the rows, if that is known."""
    hashes = ids.select(short_hash(F.col(ids.columns[0])).alias("h")).distinct()
    short = cut(hashes) if most is None else cut_few(hashes, most)
    if short.count() > MOST_AMONG:
        return None
    return ids.sparkSession.sparkContext.broadcast(np.sort(short.toArrow().column("h").to_numpy()))


def held(have: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    at = np.minimum(np.searchsorted(have, x), len(have) - 1)
    return have[at] == x if len(have) else np.zeros(len(x), bool)


def among(ids: DataFrame, most: int | None = None) -> Callable[[Column], Column]:
    """Whether a value is one of ``ids`` (one column of its type), or in rare cases another: a test by 32 bits of a hash, four bytes an id in each task.

    ``most`` bounds the rows of ``ids``, if that is known. It tells which rows need not go to a join. Beyond ``MOST_AMONG`` ids it lets all rows pass, so the driver's part is bounded.
    A Python function over the rows that pass, in the same task, takes a second worker: it had better ask :func:`held` itself.
    """
    known = short_hashes(ids, most)
    if known is None:
        return lambda column: F.lit(True)

    @F.pandas_udf("boolean")
    def is_held(h: pd.Series) -> pd.Series:
        return pd.Series(held(known.value, h.to_numpy(np.int32)))

    return lambda column: is_held(short_hash(column))


def small_batches(spark: SparkSession) -> None:
    """Texts go to the workers in Arrow batches of at most ``BATCH_ROWS``, so that buffers on both sides stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tidy(function):
    """``function`` for ``mapInArrow``; at its end the worker, which later tasks reuse, gives freed memory back."""

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most ``limit`` bytes, or of one row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_BASE = _U(0x5851F42D4C957F2D)
_INVERSE = _U(pow(int(_BASE), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_bounds(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each row (n+1 values)."""
    inside = ~_IS_SEP[body]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(body)]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes at any place."""
    up, down = powers(len(body) + 1)
    total = np.empty(len(body) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[body] * up[: len(body)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lowered(body: np.ndarray) -> np.ndarray:
    return _LOWER[body]


def shingle_sets(body: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its word shingles; fewer words make one shingle, none an empty set."""
    starts, ends, first = word_bounds(body, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    words = span_hashes(lowered(body), starts, ends)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : n - width + 1 + k] * _STEP[k % 5] if n >= width else 0
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            few = words[a:b].copy()
            few *= np.array(_STEP[: b - a], np.uint64)
            out.append(mix(few.sum(keepdims=True, dtype=np.uint64) ^ _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
