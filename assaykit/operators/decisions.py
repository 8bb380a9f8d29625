"""Thresholds, score diagnostics, comparisons of runs, strata and mined rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_mean, ratio
from .metrics import binary_metrics
from .ranks import running_before, value_places


def select_threshold(sweep: DataFrame, default: int = 50) -> DataFrame:
    """Bin of the best balanced accuracy, then lower false-positive rate; the default wins exact ties."""
    order = F.struct(F.round("macro_ba", 9), -F.round("macro_fpr", 9), (F.col("bin") == default).cast("int"), -F.col("bin"))
    return sweep.agg(F.max_by(F.struct("bin", "macro_ba", "macro_fpr"), order).alias("s")).select("s.*")


def unit_sweep(df: DataFrame, steps: int = 100) -> DataFrame:
    """Balanced accuracy of each unit with both classes at each threshold k/steps."""
    binned = df.withColumn("bin", F.floor(F.col("score") * steps).cast("int")).groupBy("unit", "bin").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    units = binned.groupBy("unit").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg")).filter("pos > 0 AND neg > 0")
    grid = units.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(steps)))).join(binned, ["unit", "bin"], "left")
    down = Window.partitionBy("unit").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    tp, fp = (F.sum(F.coalesce(c, F.lit(0))).over(down) for c in ("p", "n"))
    return grid.select("unit", "bin", ((tp / F.col("pos") + 1 - fp / F.col("neg")) / 2).alias("ba"))


def loo_threshold(df: DataFrame, steps: int = 100) -> DataFrame:
    """Each unit's balanced accuracy at the threshold that is best for all other units; the higher one wins ties."""
    sweep = unit_sweep(df, steps)
    total = sweep.groupBy("bin").agg(F.sum("ba").alias("sum"))
    rest = sweep.join(total, "bin").withColumn("rest", F.round(F.col("sum") - F.col("ba"), 9))
    return rest.groupBy("unit").agg(F.max_by(F.struct("bin", "ba"), F.struct("rest", "bin")).alias("s")).select("unit", "s.bin", "s.ba")


def operating_point(df: DataFrame, least_emitted: int, least_precision: float) -> DataFrame:
    """Threshold per unit among its distinct scores: most correct, then most emitted, under both floors; else abstain."""
    hist = df.groupBy("unit", "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    below = running_before(hist.withColumn("__down", F.coalesce(-F.col("score"), F.lit(float("inf")))), ["unit"], "__down", ["p", "n"])
    run = below.select("unit", "score", (F.col("p_before") + F.col("p")).alias("correct"), (F.col("n_before") + F.col("n")).alias("emitted"))
    ok = (F.col("emitted") >= least_emitted) & (F.col("correct") >= least_precision * F.col("emitted"))
    best = run.groupBy("unit").agg(F.max_by(F.struct("score", "correct", "emitted"), F.when(ok, F.struct("correct", "emitted"))).alias("s"), F.max("score").alias("top"))
    return best.select("unit", F.coalesce("s.score", F.col("top") + 1e-6).alias("threshold"), F.coalesce("s.correct", F.lit(0)).alias("correct"), F.coalesce("s.emitted", F.lit(0)).alias("emitted"))


def score_diagnostics(df: DataFrame) -> DataFrame:
    """Distinct scores, duplicate share, saturation and quartiles per unit."""
    n = F.count(F.lit(1))
    q = lambda p: F.percentile("score", p)
    return df.groupBy("unit").agg(n.alias("n"), F.count_distinct("score").alias("distinct"), (1 - F.count_distinct("score") / n).alias("duplicates"), F.count_if(F.col("score") < 1e-6).alias("low"), F.count_if(F.col("score") > 1 - 1e-6).alias("high"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"))


def unit_wins(a: DataFrame, b: DataFrame, least: float = 1e-12) -> DataFrame:
    """Units in which b's balanced accuracy is above, equal to or under a's; best and worst change."""
    one = binary_metrics(a, ["unit"]).select("unit", F.col("balanced_accuracy").alias("x"))
    two = binary_metrics(b, ["unit"]).select("unit", F.col("balanced_accuracy").alias("y"))
    d = one.join(two, "unit").select((F.col("y") - F.col("x")).alias("d")).filter("d IS NOT NULL")
    return d.agg(F.count_if(F.col("d") > least).alias("wins"), F.count_if(F.abs("d") <= least).alias("ties"), F.count_if(F.col("d") < -least).alias("losses"), F.max("d").alias("best"), F.min("d").alias("worst"))


def length_strata(df: DataFrame, length: str, by: str = "unit", parts: int = 3) -> DataFrame:
    """Accuracy in equal parts of each unit by length, ties by index."""
    placed = value_places(df, [by], F.col(length).cast("double"), ["index"])
    size, more = F.floor(F.col("__n") / parts), F.col("__n") % parts  # the first parts have one row more
    part = F.when(F.col("__r") <= more * (size + 1), F.floor((F.col("__r") - 1) / (size + 1))).otherwise(more + F.floor((F.col("__r") - 1 - more * (size + 1)) / size)) + 1
    return placed.withColumn("part", part.cast("int")).groupBy(by, "part").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("decision")).cast("int")).alias("accuracy"))


def flag_audit(df: DataFrame, flag: str, by: list[str]) -> DataFrame:
    """Flags, true and false ones, precision and the share of positives flagged."""
    f, y = F.col(flag) == 1, F.col("label") == 1
    g = df.groupBy(*by).agg(F.count_if(f).alias("flags"), F.count_if(f & y).alias("hits"), F.count_if(f & ~y).alias("false_flags"), F.count_if(y).alias("positives"))
    return g.select(*by, "flags", "hits", "false_flags", ratio(F.col("hits"), F.col("flags")).alias("precision"), ratio(F.col("hits"), F.col("positives")).alias("coverage"))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of value pairs with their share of the row value."""
    c = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def wilson_lower(hits, n, z: float = 1.0):
    """Lower end of the Wilson interval of hits of n; n must be above 0."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(rows: DataFrame, terms: str, least: int) -> DataFrame:
    """Wilson lower bound of the positive share of rows that hold a term, for terms of a least support."""
    t = rows.select("label", F.explode(F.array_distinct(terms)).alias("term"))
    g = t.groupBy("term").agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("label") == 1).alias("positives")).filter((F.col("support") >= least) & (F.col("positives") > 0))
    return g.withColumn("lower", wilson_lower(F.col("positives"), F.col("support")))


def apply_rules(rows: DataFrame, rules: DataFrame, key: str, terms: Column) -> DataFrame:
    """``key, score``: the greatest lower bound of the rules whose term a row holds, 0 where there is none. Null texts hold none."""
    held = rows.select(key, F.explode(F.array_distinct(terms)).alias("term")).join(rules.select("term", "lower"), "term").groupBy(key).agg(F.max("lower").alias("score"))
    return rows.select(key).join(held, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def summarize_submissions(records: DataFrame) -> DataFrame:
    """All or nothing over the units of a submission: its mean, or the first failed unit."""
    g = records.groupBy("team", "notebook", "submitted_at").agg(F.bool_and("ok").alias("ok"), exact_mean(F.col("metric")).alias("mean"), F.min(F.when(~F.col("ok"), F.col("unit"))).alias("failed_unit"), F.count(F.lit(1)).alias("units"))
    return g.withColumn("mean", F.when(F.col("ok"), F.col("mean")))


def recovery_at_k(ranked: DataFrame, key: str, ks: list[int]) -> DataFrame:
    """Queries whose first match (``hit``) has a rank of at most k."""
    first = ranked.groupBy(key).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return first.agg(F.count(F.lit(1)).alias("asked"), *[F.count_if(F.col("first") <= k).alias(f"at_{k}") for k in ks])
