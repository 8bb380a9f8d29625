"""Row selection by score, digest or pattern; rank fusion; budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import stable_digest
from .metrics import average_ranks
from .ranks import digest_places, value_places


def scored_fraction(df: DataFrame, fraction: float, strata: list[str], seed: str = "control", key: str = "index") -> DataFrame:
    """Per stratum the top round(n f) rows by score, and as many rows by digest as a control."""
    placed = digest_places(value_places(df, strata, -F.col("score"), [key], "__a", "__n"), strata, seed, key, "__b", "__m")
    n = F.bround(F.col("__n") * F.lit(fraction))
    marked = placed.withColumn("top", (F.col("__a") <= n).cast("int")).withColumn("control", (F.col("__b") <= n).cast("int"))
    return marked.filter("top = 1 OR control = 1").drop("__a", "__b", "__n", "__m")


def anchored_sample(df: DataFrame, fraction: float, middle: float, strata: list[str], key: str = "index") -> DataFrame:
    """The same share of rows nearest to and farthest from the middle score, at most half of a stratum each."""
    placed = value_places(df, strata, F.abs(F.col("score") - middle), [key])
    n = F.least(F.floor(F.col("__n") * fraction + 0.5), F.floor(F.col("__n") / 2))
    return placed.withColumn("kind", F.when(F.col("__r") <= n, "near").when(F.col("__r") > F.col("__n") - n, "far")).filter("kind IS NOT NULL").drop("__r", "__n")


def hard_with_controls(df: DataFrame, hard: Column, share: float, seed: str = "hard", key: str = "index") -> DataFrame:
    """All hard positives and round(share x their number) negatives by digest: the first of a sorted table, not places of all of it."""
    positives = df.filter((F.col("label") == 1) & hard)
    n = int(positives.agg(F.bround(F.count(F.lit(1)) * F.lit(share))).first()[0] or 0)
    chosen = df.filter("label = 0").withColumn("__d", stable_digest(seed, key)).orderBy("__d", key).limit(n).drop("__d")
    return positives.unionByName(chosen)


def rank_average(tables: list[DataFrame], unit: str = "unit") -> DataFrame:
    """Mean over runs of the percentile rank (average ties) of a row within its unit."""
    def percentile(t: DataFrame) -> DataFrame:
        sizes = t.groupBy(F.col(unit).alias("__u")).agg(F.count(F.lit(1)).alias("__t"))
        ranked = average_ranks(t, unit, "score", "__r").join(sizes, F.col(unit).eqNullSafe(F.col("__u")))
        return ranked.select("index", unit, (F.col("__r") / F.col("__t")).alias("__p"))

    parts = [percentile(t) for t in tables]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("index", unit).agg(F.avg("__p").alias("fused"))


def char_budget(parts: Column, n: int) -> Column:
    """Parts in order while they fit; one that does not fit is skipped, later ones may still fit."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    step = lambda a, x: F.when(a["used"] + F.length(x) <= n, F.struct((a["used"] + F.length(x)).alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    return F.aggregate(parts, start, step, lambda a: a["kept"])


def sentence_windows(df: DataFrame, key: str, place: str, text: str, most: int = 3) -> DataFrame:
    """Every run of 1 to ``most`` adjacent sentences of a text."""
    w = Window.partitionBy(key).orderBy(place)
    out = df
    for k in range(1, most):
        out = out.withColumn(f"__t{k}", F.lead(text, k).over(w))
    runs = [F.struct(F.lit(size).alias("size"), F.concat_ws(" ", text, *[f"__t{k}" for k in range(1, size)]).alias("window"), (F.lit(True) if size == 1 else F.col(f"__t{size - 1}").isNotNull()).alias("full")) for size in range(1, most + 1)]
    return out.select(key, place, F.explode(F.array(*runs)).alias("r")).filter("r.full").select(key, place, "r.size", "r.window")


def quota_sample(df: DataFrame, total: int, strata: list[str], seed: str = "quota", key: str = "index") -> DataFrame:
    """A total spread over strata as evenly as their sizes allow: the i-th rows of all strata before any (i+1)-th."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(stable_digest(seed, key), key))
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("__n"))
    # Rows at each place over all strata. No place holds none before a later one holds some, so ``total`` places are enough.
    levels = counts.select(F.explode(F.sequence(F.lit(1), F.least(F.col("__n").cast("int"), F.lit(total)))).alias("__i")).groupBy("__i").agg(F.count(F.lit(1)).alias("__c"))
    before = levels.withColumn("__before", F.sum("__c").over(Window.orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)))
    rest = F.lit(total) - F.coalesce(F.col("__before"), F.lit(0))
    ranked = df.withColumn("__i", place).filter(F.col("__i") <= total).join(before, "__i").filter(rest > 0).withColumn("__rest", rest)
    last = F.row_number().over(Window.partitionBy("__i").orderBy(*strata))
    return ranked.withColumn("__k", last).filter("__k <= __rest").drop("__i", "__c", "__before", "__rest", "__k")
