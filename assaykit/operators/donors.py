"""Matched shuffles: every row gets the evidence of a row of another unit, with as many passages as its own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrowtext import cut
from .ranks import value_places

RANGE = 65_536  # places that one window covers
PAIRS_A_PLACE = 16
BLOCKS, MOST_BLOCK = 8, 2**21  # of places that a correlation covers, and the most of one


def _next_start(placed: DataFrame, by: list[str]) -> DataFrame:
    """``__next``: the first place behind a row's own where another run of units begins, from windows over ranges of places."""
    rows = placed.withColumn("__range", F.floor(F.col("__i") / RANGE))
    later = F.when(F.col("__start"), F.col("__i"))
    ahead = Window.partitionBy(*by, "__range").orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.filter("__start").groupBy(*by, "__range").agg(F.min("__i").alias("__f"))
    ranges = rows.select(*by, "__range").distinct()
    behind = Window.partitionBy(*by).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    nexts = ranges.join(firsts, [*by, "__range"], "left").withColumn("__h", F.min("__f").over(behind)).drop("__f")
    return rows.withColumn("__n", F.min(later).over(ahead)).join(nexts, [*by, "__range"]).withColumn("__next", F.coalesce("__n", "__h")).drop("__n", "__h", "__range")


def next_donors(df: DataFrame, unit: str, key: str, count: str) -> DataFrame:
    """``key, donor``: within the rows of one count, in the order of keys, the next row of another unit, from the end on to the first again.

    The donor's passages are as many as the row's. Rows whose count is 0 or null, and rows in a count that only their own unit has, have no
    donor (see ``fallback_passages``). A unit must not be null; keys are unique numbers. Runs of a unit are found by
    comparing neighbours, so no count is one task.
    """
    rows = df.filter(F.col(count) > 0).select(unit, key, F.col(count).alias("__own"))
    placed = value_places(rows, ["__own"], F.col(key).cast("double"), [key], "__i", "__total")
    placed = cut(placed.withColumn("__i", F.col("__i") - 1))
    before = placed.select("__own", (F.col("__i") + 1).alias("__i"), F.col(unit).alias("__before"))
    marked = placed.join(before, ["__own", "__i"], "left").withColumn("__start", F.col("__before").isNotNull() & (F.col("__before") != F.col(unit))).drop("__before")
    marked = cut(_next_start(marked, ["__own"]))
    starts = marked.filter("__start").groupBy("__own").agg(F.min("__i").alias("__first"))
    zero = marked.filter("__i = 0").select("__own", F.col(unit).alias("__zero"))
    asks = marked.join(zero, "__own").join(starts, "__own", "left")
    wrapped = F.when(F.col("__zero") != F.col(unit), F.lit(0)).otherwise(F.col("__first"))
    asks = asks.withColumn("__at", F.coalesce("__next", wrapped))
    gives = marked.select("__own", F.col("__i").alias("__at"), F.col(key).alias("donor"))
    found = asks.join(gives, ["__own", "__at"], "left").select(key, "donor")
    return found.unionByName(df.filter(F.col(count).isNull() | (F.col(count) <= 0)).select(key, F.lit(None).cast(dict(df.dtypes)[key]).alias("donor")))


def fallback_passages(df: DataFrame, donors: DataFrame, unit: str, key: str, count: str) -> DataFrame:
    """``key, place, donor``: for rows with passages but no donor the first passages of other units in the order of keys, as many as their own.

    One row for each passage: ``place`` from 0, ``donor`` the key of the row that gives it. Only the first rows of each unit can serve,
    so no more than the largest count of passages of a unit is kept.
    """
    rows = df.filter(F.col(count) > 0).select(unit, key, F.col(count).alias("__own"))
    needy = cut(rows.join(donors.filter("donor IS NULL").select(key), key))
    most = needy.agg(F.max("__own")).first()[0]
    schema = f"{key} {dict(df.dtypes)[key]}, place int, donor {dict(df.dtypes)[key]}"
    if most is None:
        return df.sparkSession.createDataFrame([], schema)
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy(unit).orderBy(key))).filter(F.col("r") <= most)
    passages = first.select(F.col(unit).alias("__u"), F.col(key).alias("donor"), F.explode(F.sequence(F.lit(1), F.least("__own", F.lit(most)))).alias("p"))
    passages = cut(passages.withColumn("r", F.row_number().over(Window.partitionBy("__u").orderBy("donor", "p"))).filter(F.col("r") <= most).drop("r"))
    units = passages.agg(F.collect_set("__u").alias("__all"))  # one row; an entry a unit
    asked = needy.select(unit).distinct().join(F.broadcast(units)).select(unit, F.explode(F.array_except("__all", F.array(unit))).alias("__u"))
    usable = asked.join(passages, "__u").withColumn("place", F.row_number().over(Window.partitionBy(unit).orderBy("donor", "p")) - 1).filter(F.col("place") < most)
    return needy.join(usable.select(unit, "place", "donor"), unit).filter(F.col("place") < F.col("__own")).select(key, "place", "donor")


def _shift_counts(n: int, length: int):
    """``shift, repeats`` of one pair of blocks: how many equal indexes lie each distance apart, by FFT; counts are whole numbers, so rounding makes them exact."""
    width = 1 << (2 * length - 1).bit_length()

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(width // 2 + 1, complex)
        for a, b in zip(table.column("a"), table.column("b"), strict=True):
            one, two = (np.fft.rfft(np.bincount(x.values.to_numpy(), minlength=width)) for x in (a, b))
            total += np.conj(one) * two
        counts = np.rint(np.fft.irfft(total, width)).astype(np.int64)
        apart = np.arange(width)
        apart[width // 2 :] -= width
        met = np.flatnonzero(counts)
        start = (table.column("j")[0].as_py() - table.column("i")[0].as_py()) * length
        return pa.table({"shift": (start + apart[met]) % n, "repeats": counts[met]})

    return run


def choose_rotation(recipients: DataFrame, donors: DataFrame, place: str, index: str) -> DataFrame:
    """One row ``shift, repeats``: the rotation of the donors, of as many places 0 to n - 1, that meets equal indexes least often.

    Each pair of equal indexes rules out one rotation. Pairs of an index that makes at most ``PAIRS_A_PLACE`` times n of them are joined and
    counted; all rotations of a more frequent one are counted together, as the correlation of its places in a block of the
    recipients with those in a block of the donors, so the work is n log n for each of them (there are at most the root of n) and none is
    tried. Ties go to the smaller shift. Two tables of different or no size are an error.
    """
    n, m = recipients.count(), donors.count()
    if n != m or not n:
        raise ValueError(f"{n} recipients and {m} donors")
    asks, gives = (cut(side.select(F.col(place).cast("long").alias("__p"), F.col(index).alias("__x")).filter("__x IS NOT NULL")) for side in (recipients, donors))
    times = lambda side, c: side.groupBy("__x").agg(F.count(F.lit(1)).alias(c))
    often = cut(times(asks, "__a").join(times(gives, "__b"), "__x").filter(F.col("__a") * F.col("__b") > PAIRS_A_PLACE * n).select("__x"))
    rare = [side.join(often, "__x", "left_anti") for side in (asks, gives)]
    shift = F.pmod(F.col("__q") - F.col("__p"), F.lit(n)).cast("long").alias("shift")
    repeats = rare[0].join(rare[1].withColumnRenamed("__p", "__q"), "__x").groupBy(shift).agg(F.count(F.lit(1)).alias("repeats"))
    if not often.isEmpty():
        length = max(1, min(MOST_BLOCK, -(-n // BLOCKS)))
        blocks = lambda side, c, i: side.join(often, "__x").groupBy("__x", F.floor(F.col("__p") / length).alias(i)).agg(F.collect_list((F.col("__p") % length).cast("int")).alias(c))
        met = blocks(asks, "a", "i").join(blocks(gives, "b", "j"), "__x").select("i", "j", "a", "b")
        counted = met.groupBy("i", "j").applyInArrow(_shift_counts(n, length), "shift long, repeats long")
        repeats = repeats.unionByName(counted).groupBy("shift").agg(F.sum("repeats").alias("repeats"))
    every = recipients.sparkSession.range(n).withColumnRenamed("id", "shift").join(repeats, "shift", "left")
    return every.select("shift", F.coalesce("repeats", F.lit(0)).alias("repeats")).orderBy("repeats", "shift").limit(1)


def rotated(recipients: DataFrame, donors: DataFrame, place: str, key: str, index: str) -> DataFrame:
    """``key, donor``: each recipient's donor under the chosen rotation."""
    n = recipients.count()
    shift = choose_rotation(recipients, donors, place, index).first()["shift"]
    asks = recipients.select(key, F.pmod(F.col(place) + shift, F.lit(n)).alias("__at"))
    return asks.join(donors.select(F.col(place).alias("__at"), F.col(key).alias("donor")), "__at").select(key, "donor")
