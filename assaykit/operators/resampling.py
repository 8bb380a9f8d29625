"""Bootstraps of paired changes, drawn from what a sample's result depends on and never from gathered rows.

Balanced accuracy depends on four counts: of each label, how many rows the second scorer decides and the first doesn't, and the
other way round. A sample of n of n rows is two binomial draws a label, by inversion of one hashed number each, so the
work is units times samples whatever the number of rows. AUROC depends on how often each distinct pair of scores is drawn: a
unit's pairs with their counts go to every task that draws some of its samples.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio, stable_fraction
from .ranks import running_before

SAMPLES_A_ROW = 125
DRAWN_AT_ONCE = 1_000_000  # cells times samples whose counts a worker holds
MOST_CELLS = 1_000_000  # distinct pairs of scores of all units, 40 bytes each; beyond it rows get Poisson weights
_WINDOW = 40  # standard deviations of a binomial variable that its table covers; what lies beyond is under 1e-300
#: The distribution function of a Poisson variable of mean 1 at 0 to 6.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def interval(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Mean, 2.5 and 97.5 % quantiles and share above 0 of the deltas of the samples; samples without a delta are left out."""
    q = lambda p: F.percentile("delta", F.lit(p))
    return deltas.filter(F.col("delta").isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.avg("delta").alias("mean"), q(0.025).alias("low"), q(0.975).alias("high"), F.avg((F.col("delta") > 0).cast("double")).alias("above"))


def _macro(deltas: DataFrame, by: str) -> DataFrame:
    """The intervals of the units, and of the mean over units of each sample (unit NULL)."""
    macro = deltas.groupBy("sample").agg(F.avg("delta").alias("delta")).select(F.lit(None).cast("string").alias(by), "sample", "delta")
    return interval(deltas.unionByName(macro), [by])


def binomial_table(n: int, p: float) -> tuple[int, np.ndarray]:
    """The least value of the table and the distribution function of Binomial(n, p) from there on."""
    if p <= 0 or p >= 1 or not n:
        return (n if p >= 1 else 0), np.zeros(0)
    reach = _WINDOW * math.sqrt(n * p * (1 - p)) + _WINDOW
    low, high = max(0, int(n * p - reach)), min(n, int(n * p + reach))
    start = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) + low * math.log(p) + (n - low) * math.log1p(-p)
    k = np.arange(low, high)
    steps = np.log((n - k) / (k + 1)) + (math.log(p) - math.log1p(-p))
    return low, np.cumsum(np.exp(start + np.concatenate([[0.0], np.cumsum(steps)])))[: high - low]


def binomial_draws(n: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial(n, a / b) at the numbers u in [0, 1), by inversion; a table for each distinct (n, a, b)."""
    keys, place = np.unique(np.stack([n, a, b], 1), axis=0, return_inverse=True)
    out = np.zeros(len(u), np.int64)
    order = np.argsort(place.ravel(), kind="stable")
    edges = np.searchsorted(place.ravel()[order], np.arange(len(keys) + 1))
    for (size, hit, of), x, y in zip(keys.tolist(), edges[:-1], edges[1:], strict=True):
        low, table = binomial_table(size, hit / of if of else 0.0)
        out[order[x:y]] = low + np.searchsorted(table, u[order[x:y]], side="right")
    return out


def _moves(batches):
    """``gain``: the mean change of a decision in a sample of a label's rows."""
    for batch in batches:
        n, up, down, u, v = (batch.column(c).to_numpy() for c in ("n", "up", "down", "u", "v"))
        moved = binomial_draws(n, up + down, n, u)
        raised = binomial_draws(moved, up, up + down, v)
        gain = pa.array((2 * raised - moved) / n)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), gain], names=[*batch.schema.names[:3], "gain"])


def bootstrap_ba(df: DataFrame, by: str, samples: int, seed: str = "ba", label: str = "label", a: str = "decision", b: str = "other") -> DataFrame:
    """Paired bootstrap of the change of balanced accuracy from a to b, per unit and as the mean over units (unit NULL).

    Positives and negatives are drawn apart, n of n. A unit that lacks a label has no delta; NULL decisions count as 0.
    """
    change = F.coalesce(F.col(b), F.lit(0)) - F.coalesce(F.col(a), F.lit(0))
    cells = df.filter(F.col(label).isin(0, 1)).groupBy(by, F.col(label).cast("int").alias("l"))
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.count_if(change > 0).alias("up"), F.count_if(change < 0).alias("down"))
    drawn = cells.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    number = lambda part: stable_fraction(seed + part, "sample", F.coalesce(by, F.lit("")), "l")
    drawn = drawn.select(by, "l", "sample", "n", "up", "down", number("u").alias("u"), number("v").alias("v"))
    kind = dict(df.dtypes)[by]
    moves = drawn.mapInArrow(_moves, f"`{by}` {kind}, l int, sample int, gain double")
    gain = lambda y: F.sum(F.when(F.col("l") == y, F.col("gain")))
    return _macro(moves.groupBy(by, "sample").agg(((gain(1) - gain(0)) / 2).alias("delta")).filter("delta IS NOT NULL"), by)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that changes half of the bits for every bit of the argument."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def draw_counts(counts: np.ndarray, start: int, samples: np.ndarray) -> np.ndarray:
    """How often each cell is drawn in n of n hashed draws, one row for each sample."""
    n, ends = int(counts.sum()), np.cumsum(counts)
    place = np.arange(n, dtype=np.uint32)
    out = np.zeros((len(samples), len(counts)), np.int64)
    for i, s in enumerate(mix32(np.uint32(start) + samples.astype(np.uint32))):
        drawn = (mix32(s + place).astype(np.uint64) * np.uint64(n)) >> np.uint64(32)
        out[i] = np.bincount(np.searchsorted(ends, drawn.astype(np.int64), side="right"), minlength=len(counts))
    return out


def _aurocs(pos: np.ndarray, wp: np.ndarray, neg: np.ndarray, wn: np.ndarray) -> np.ndarray:
    """AUROC of each sample, ties at half credit; from running sums of the drawn negatives."""
    order = np.argsort(neg, kind="stable")
    below = np.concatenate([np.zeros((len(wn), 1)), np.cumsum(wn[:, order], 1)], 1)
    ranked = neg[order]
    wins = below[:, np.searchsorted(ranked, pos, side="left")] + below[:, np.searchsorted(ranked, pos, side="right")]
    return (wins * wp).sum(1) / (2.0 * wp.sum(1) * wn.sum(1))


def _auroc_samples(batches):
    """``sample, delta`` of a unit's samples; rows hold its cells and the first and number of the samples to draw."""
    for batch in batches:
        for row in range(batch.num_rows):
            unit = batch.slice(row, 1)
            flat = unit.column("cells").flatten()
            label, x, y, c = (flat.field(i).to_numpy() for i in range(4))
            first, n, seed = (unit.column(k)[0].as_py() for k in ("first", "samples", "seed"))
            numbers = np.arange(first, first + n)
            own = [label == 1, label == 0]
            starts = mix32(np.array([seed, seed ^ 0x9E3779B9], np.uint32))
            at_once = max(1, DRAWN_AT_ONCE // len(c))
            for at in range(0, n, at_once):
                some = numbers[at : at + at_once]
                wp, wn = (draw_counts(c[k], s, some) for k, s in zip(own, starts, strict=True))
                delta = _aurocs(y[own[0]], wp, y[own[1]], wn) - _aurocs(x[own[0]], wp, x[own[1]], wn)
                yield pa.RecordBatch.from_arrays([unit.column(0).take(pa.array([0] * len(some))), pa.array(some.astype(np.int32)), pa.array(delta)], names=[unit.schema.names[0], "sample", "delta"])


def bootstrap_auroc(df: DataFrame, by: str, key: str, x: str, y: str, samples: int, seed: str = "auroc", label: str = "label") -> DataFrame:
    """Paired bootstrap of the change of AUROC from x to y, per unit and as the mean over units (unit NULL).

    Positives and negatives are drawn apart, n of n, both scores of a drawn row together. Rows without a label or a score take no
    part; a unit that lacks a label has no delta. With over ``MOST_CELLS`` distinct pairs of scores rows are weighted by hashed
    Poisson(1) draws instead, which n of n draws approach, so that no unit has to fit a task.
    """
    rows = df.filter(F.col(label).isin(0, 1) & F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = rows.groupBy(by, F.col(label).cast("int").alias("l"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    cells = cells.agg(F.count(F.lit(1)).alias("c"))
    if cells.count() > MOST_CELLS:
        return _macro(_poisson_auroc(rows, by, key, x, y, samples, seed, label), by)
    both = (F.max("l") == 1) & (F.min("l") == 0)
    units = cells.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("l", "x", "y", "c"))).alias("cells"), both.alias("ok")).filter("ok")
    start = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(by, F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    parts = units.select(by, "cells", start.alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(samples), F.lit(SAMPLES_A_ROW))).alias("first"))
    parts = parts.withColumn("samples", F.least(F.lit(SAMPLES_A_ROW), samples + 1 - F.col("first")))
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = parts.repartition(n_parts, by, "first").mapInArrow(_auroc_samples, f"`{by}` {dict(df.dtypes)[by]}, sample int, delta double")
    return _macro(drawn, by)


def poisson_weight(seed: str, *columns: Column | str) -> Column:
    """A Poisson(1) draw from the digest of the columns: the weight of a row in a bootstrap sample."""
    u = stable_fraction(seed, *columns)
    weight = F.lit(0)
    for c in POISSON:
        weight = weight + (u >= c).cast("int")
    return weight


def _resampled(df: DataFrame, samples: int, seed: str, key: str) -> DataFrame:
    return df.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("w", poisson_weight(seed, "sample", key)).filter("w > 0")


def _weighted_auroc(rows: DataFrame, by: list[str], score: str, label: str, name: str) -> DataFrame:
    hist = rows.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, F.col("w")).otherwise(0)).alias("n"))
    sums = running_before(hist, by, score, ["n"]).withColumn("wins", F.col("p") * (F.col("n_before") + F.col("n") / 2)).groupBy(*by).agg(F.sum("wins").alias("x"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(*by, ratio(F.col("x"), F.col("p") * F.col("n")).alias(name))


def _poisson_auroc(df: DataFrame, by: str, key: str, x: str, y: str, samples: int, seed: str, label: str) -> DataFrame:
    rows = _resampled(df.select(by, key, label, x, y), samples, seed, key)
    a, b = (_weighted_auroc(rows, [by, "sample"], c, label, n) for c, n in ((x, "a"), (y, "b")))
    return a.join(b, [by, "sample"]).select(by, "sample", (F.col("b") - F.col("a")).alias("delta"))


def bootstrap_units(deltas: DataFrame, by: str, samples: int, seed: str = "units") -> DataFrame:
    """Interval of the mean delta over units drawn with replacement; one row a unit, so the numbering is one small window."""
    units = deltas.filter(F.col("delta").isNotNull()).select(F.row_number().over(Window.orderBy(by)).alias("i"), "delta", F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    n = units.agg(F.max("n").alias("n"))
    draws = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    picked = draws.select("sample", (F.floor(stable_fraction(seed, "sample", "draw") * F.col("n")) + 1).cast("int").alias("i")).join(F.broadcast(units.drop("n")), "i")
    return interval(picked.groupBy("sample").agg(F.avg("delta").alias("delta")), [])
