"""Greedy batches of rows in ascending length, without a pass over the rows.

Where a batch ends depends only on where it starts, and rows of equal length are alike. So the greedy pass runs over the
distinct lengths and their counts: all batches within one length follow at once from their size, and only a batch that goes on into
longer rows is followed step by step. The pass gives segments of equal batches, to which rows are matched by their place.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import value_places

MOST_LENGTHS = 2_000_000  # distinct lengths, 16 bytes each, that pass the driver
TIERS = ((600, 48), (900, 32), (None, 16))


@dataclasses.dataclass(frozen=True)
class Limits:
    """When a batch is full. ``rows`` caps its rows; ``padded`` rows times the longest; ``flat`` the sum of lengths; ``tiers`` caps rows by the longest."""

    rows: int
    padded: int | None = None
    flat: int | None = None
    tiers: tuple[tuple[int | None, int], ...] = ()

    def cap(self, length: int) -> int:
        """Rows that a batch may have whose longest row is of this length, apart from the sum of lengths."""
        out = self.rows if self.padded is None else min(self.rows, self.padded // max(1, length))
        return next((min(out, n) for upto, n in self.tiers if upto is None or length <= upto), out)

    def more(self, count: int, total: int, length: int) -> int:
        """How many rows of this length, none shorter to come, still fit a batch of so many rows and so much length."""
        out = self.cap(length) - count
        return out if self.flat is None else min(out, (self.flat - total) // max(1, length))


def segments(lengths: list[int], counts: list[int], limits: Limits) -> list[tuple[int, int, int]]:
    """(first place, rows, number) of runs of equal batches, by the greedy pass; every batch has one row at least."""
    out: list[tuple[int, int, int]] = []
    i, used, place = 0, 0, 0  # rows of length i that are taken
    while i < len(lengths):
        size = max(1, limits.more(0, 0, lengths[i]))
        left = counts[i] - used
        if left >= size:
            n = left // size
            out.append((place, size, n))
            place, used = place + n * size, used + n * size
            left -= n * size
        if not left:
            i, used = i + 1, 0
            continue
        # A batch of all that is left of this length, and of longer rows as far as they fit.
        count, total = left, left * lengths[i]
        i, used = i + 1, 0
        while i < len(lengths):
            fit = max(0, limits.more(count, total, lengths[i]))
            if fit < counts[i]:
                count, used = count + fit, fit
                break
            count, total, i = count + counts[i], total + counts[i] * lengths[i], i + 1
        out.append((place, count, 1))
        place += count
    return out


def _numbered(batches, sent):
    starts, sizes, before = sent.value
    for batch in batches:
        place = batch.column(batch.num_columns - 1).to_numpy() - 1
        at = np.searchsorted(starts, place, side="right") - 1
        number = before[at] + (place - starts[at]) // sizes[at]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(number)], names=[*batch.schema.names[:-1], "batch"])


def budget_batches(df: DataFrame, key: str, length: str, limits: Limits) -> DataFrame:
    """``key, length, batch``: batches from 0 of the rows in ascending length (ties by key), each as large as the limits allow.

    A row over the budget is a batch of its own. Null lengths are left out; lengths are whole numbers from 0 on. The distinct lengths pass the
    driver, at most ``MOST_LENGTHS`` of them (an error beyond it); the rows are placed by ranges and never gathered.
    """
    rows = df.filter(F.col(length).isNotNull()).select(key, length)
    histogram = rows.groupBy(F.col(length).cast("long").alias("l")).agg(F.count(F.lit(1)).alias("n"))
    cells = sorted((r["l"], r["n"]) for r in histogram.limit(MOST_LENGTHS + 1).collect())
    if len(cells) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} distinct lengths")
    runs = segments([c[0] for c in cells], [c[1] for c in cells], limits)
    starts, sizes, numbers = (np.array([r[i] for r in runs], np.int64) for i in range(3))
    sent = df.sparkSession.sparkContext.broadcast((starts, sizes, np.cumsum(numbers) - numbers))
    placed = value_places(rows, [], F.col(length).cast("double"), [key], "__place", "__total").select(key, length, F.col("__place").cast("long").alias("__place"))
    kinds = dict(df.dtypes)
    return placed.mapInArrow(lambda batches: _numbered(batches, sent), f"`{key}` {kinds[key]}, `{length}` {kinds[length]}, batch long")


def padding_report(batches: DataFrame, length: str) -> DataFrame:
    """One row: batches, most rows and most padded size of one, and all padding (rows x longest minus the lengths)."""
    b = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("m"), F.sum(length).alias("s"))
    return b.agg(F.count(F.lit(1)).alias("batches"), F.max("n").alias("most_rows"), F.max(F.col("n") * F.col("m")).alias("most_padded"), F.sum(F.col("n") * F.col("m") - F.col("s")).alias("padding"))
