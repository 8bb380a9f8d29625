"""Places and running sums within groups of any size.

A window over a whole group is one task. Here a group is first cut into ranges of its order, the ranges are counted, and each
range is a window of its own whose places begin where the ranges before it end. Groups may be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import stable_digest

RANGES, ACCURACY = 64, 1000


def joined(df: DataFrame, by: list[str], small: DataFrame, extra: list[str] = ()) -> DataFrame:
    """``df`` with the columns of a table of one row for each group (and extra key); NULL groups meet."""
    keys = [*by, *extra]
    names = {c: f"__k{i}" for i, c in enumerate(keys)}
    other = small.withColumnsRenamed(names)
    if not keys:
        return df.join(F.broadcast(other))  # one row
    on = None
    for c, n in names.items():
        same = F.col(c).eqNullSafe(F.col(n))
        on = same if on is None else on & same
    return df.join(other, on).drop(*names.values())


def _with_ranges(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """``__p``: how many of about ``RANGES`` quantiles of its group lie below x; equal values share a range, NULLs the first."""
    cuts = df.groupBy(*by).agg(F.percentile_approx(x, [k / RANGES for k in range(1, RANGES)], ACCURACY).alias("__cuts"))
    return joined(df, by, cuts).withColumn("__p", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(x))), F.lit(0))).withColumn("__p", F.greatest(F.lit(0), "__p")).drop("__cuts")


def _placed(rows: DataFrame, by: list[str], order: list[Column | str], out: str, total: str) -> DataFrame:
    sizes = rows.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select(*by, "__p", (F.sum("__c").over(Window.partitionBy(*by).orderBy("__p")) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy(*by)).alias(total))
    place = F.row_number().over(Window.partitionBy(*by, "__p").orderBy(*order)) + F.col("__before")
    return joined(rows, by, before, ["__p"]).withColumn(out, place).drop("__p", "__before")


def digest_places(df: DataFrame, by: list[str], seed: str, key: str, out: str = "__r", total: str = "__n") -> DataFrame:
    """The place of each row (from 1) in its group by the digest of its key, and the rows of the group; ranges are the first two hex digits."""
    rows = df.withColumn("__d", stable_digest(seed, key)).withColumn("__p", F.left("__d", F.lit(2)))
    return _placed(rows, by, ["__d", key], out, total).drop("__d")


def value_places(df: DataFrame, by: list[str], value: Column, ties: list[Column | str], out: str = "__r", total: str = "__n") -> DataFrame:
    """The place of each row (from 1) in its group by a number, ascending with NULLs first, then by the ties; and the rows of the group."""
    rows = _with_ranges(df.withColumn("__x", value), by, "__x")
    return _placed(rows, by, ["__x", *ties], out, total).drop("__x")


def running_before(cells: DataFrame, by: list[str], x: str, columns: list[str]) -> DataFrame:
    """``c_before`` for each column: its sum over the rows of the group with a smaller x. One row for each (group, x)."""
    rows = _with_ranges(cells, by, x)
    sums = rows.groupBy(*by, "__p").agg(*[F.sum(c).alias(f"__s_{c}") for c in columns])
    upto = Window.partitionBy(*by).orderBy("__p")
    offsets = sums.select(*by, "__p", *[(F.sum(f"__s_{c}").over(upto) - F.col(f"__s_{c}")).alias(f"__o_{c}") for c in columns])
    within = Window.partitionBy(*by, "__p").orderBy(x)
    out = joined(rows, by, offsets, ["__p"])
    for c in columns:
        out = out.withColumn(f"{c}_before", F.sum(c).over(within) - F.col(c) + F.col(f"__o_{c}"))
    return out.drop("__p", *[f"__o_{c}" for c in columns])


def average_places(df: DataFrame, by: list[str], x: str, out: str) -> DataFrame:
    """The average rank of each row's value in its group, ties sharing theirs; from the counts of distinct values."""
    cells = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("__m"))
    ranked = running_before(cells, by, x, ["__m"]).select(*by, x, (F.col("__m_before") + (F.col("__m") + 1) / 2.0).alias(out))
    return joined(df, by, ranked, [x])
