"""Decision and ranking metrics as grouped aggregates; NULL where a class is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import exact_mean, ratio
from .ranks import average_places, running_before, value_places


def binary_metrics(df: DataFrame, by: list[str], label: str = "label", decision: str = "decision") -> DataFrame:
    """Confusion counts, recall, false-positive rate, balanced accuracy."""
    y, d = F.col(label) == 1, F.col(decision) == 1
    out = df.groupBy(*by).agg(F.count_if(y & d).alias("tp"), F.count_if(~y & d).alias("fp"), F.count_if(~y & ~d).alias("tn"), F.count_if(y & ~d).alias("fn"))
    recall, fpr = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    return out.select("*", recall.alias("recall"), fpr.alias("fpr"), ((recall + 1 - fpr) / 2).alias("balanced_accuracy"))


def auroc(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """P(positive above negative) + half the ties, from a histogram of distinct scores per group."""
    hist = df.groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    ranked = running_before(hist, by, score, ["n"]).withColumn("wins", F.col("p") * (F.col("n_before") + F.col("n") / 2.0))
    sums = ranked.groupBy(*by).agg(F.sum("wins").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(*by, ratio(F.col("w"), F.col("p") * F.col("n")).alias("auroc"))


def score_units(df: DataFrame, unit: str = "unit") -> DataFrame:
    """All four metrics per unit."""
    return binary_metrics(df, [unit]).join(auroc(df, [unit]), unit)


def macro_mean(metrics: DataFrame) -> DataFrame:
    """Mean over the units where a metric is defined."""
    return metrics.agg(*[F.avg(c).alias(c) for c in ("recall", "fpr", "balanced_accuracy", "auroc")], F.count(F.lit(1)).alias("units"))


def cell_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Balanced accuracy where both classes exist, else accuracy."""
    m = binary_metrics(df, by)
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return m.select(*by, F.coalesce("balanced_accuracy", (F.col("tp") + F.col("tn")) / n).alias("value"), n.alias("n"))


def threshold_sweep(df: DataFrame, unit: str = "unit", steps: int = 100) -> DataFrame:
    """Macro balanced accuracy at each threshold k/steps: scores are binned, counts run down from the top."""
    binned = df.withColumn("bin", F.floor(F.col("score") * steps).cast("int")).groupBy(unit, "bin").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    units = binned.groupBy(unit).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg")).filter("pos > 0 AND neg > 0")
    grid = units.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(steps)))).join(binned, [unit, "bin"], "left")
    down = Window.partitionBy(unit).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    run = grid.withColumn("tp", F.sum(F.coalesce("p", F.lit(0))).over(down)).withColumn("fp", F.sum(F.coalesce("n", F.lit(0))).over(down))
    ba = (F.col("tp") / F.col("pos") + 1 - F.col("fp") / F.col("neg")) / 2
    return run.groupBy("bin").agg(F.avg(ba).alias("macro_ba"), F.avg(F.col("fp") / F.col("neg")).alias("macro_fpr"))


def top_fraction(df: DataFrame, fraction: float, unit: str = "unit") -> DataFrame:
    """Decision 1 for the round(f n) highest scores of a unit (half to even), ties by index."""
    placed = value_places(df, [unit], -F.col("score"), ["index"])
    return placed.withColumn("top", (F.col("__r") <= F.bround(F.lit(fraction) * F.col("__n"))).cast("int")).drop("__r", "__n")


def paired_changes(a: DataFrame, b: DataFrame, by: str = "unit") -> DataFrame:
    """Decisions that differ between two runs, as fixes and breaks."""
    j = a.join(b.select("index", F.col("decision").alias("other")), "index")
    changed = F.col("decision") != F.col("other")
    return j.groupBy(by).agg(F.count_if(changed).alias("changed"), F.count_if(changed & (F.col("other") == F.col("label"))).alias("fixes"), F.count_if(changed & (F.col("decision") == F.col("label"))).alias("breaks"))


def average_ranks(df: DataFrame, by: str, column: str, out: str) -> DataFrame:
    """Average ranks of a column within each group."""
    return average_places(df, [by], column, out)


def correlations(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Pearson and Spearman (average ranks)."""
    r = average_ranks(average_ranks(df, by, x, "rx"), by, y, "ry")
    return r.groupBy(by).agg(F.corr(x, y).alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def affine_fit(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least-squares slope, intercept and R2 per group; NULL where x does not vary. Rows with a NULL take no part."""
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def error_summary(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Mean, root mean square, median and greatest absolute difference of two columns, and how many lie within 1e-6."""
    d = F.abs(F.col(a) - F.col(b))
    return df.groupBy(by).agg(F.avg(d).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.percentile(d, 0.5).alias("median"), F.max(d).alias("most"), F.count_if(d <= 1e-6).alias("close"))


def cell_weights(df: DataFrame, cells: list[str]) -> DataFrame:
    """n / (cells x rows of the cell), so that every cell weighs the same."""
    counts = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("cells"))
    return counts.join(F.broadcast(total)).select(*cells, "rows", (F.col("n") / (F.col("cells") * F.col("rows"))).alias("weight"))


def pair_order(df: DataFrame, unit: str = "unit") -> DataFrame:
    """Positive/negative pairs of a unit by who scores higher, counted from score histograms."""
    hist = df.groupBy(unit, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    h = running_before(hist, [unit], "score", ["n"]).withColumnRenamed("n_before", "below")
    s = h.groupBy(unit).agg(F.sum(F.col("p") * F.col("below")).alias("above"), F.sum(F.col("p") * F.col("n")).alias("ties"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(unit, "above", "ties", (F.col("p") * F.col("n") - F.col("above") - F.col("ties")).alias("under"))


def margin_bins(df: DataFrame, margin: str) -> DataFrame:
    """Errors by absolute margin."""
    m = F.abs(F.col(margin))
    kind = F.when(m < 1, "[0,1)").when(m < 3, "[1,3)").when(m < 5, "[3,5)").otherwise("[5,inf)")
    return df.groupBy(kind.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") != F.col("decision")).alias("errors"))


def error_cases(df: DataFrame, n: int) -> DataFrame:
    """The n lowest-scored false negatives and highest-scored false positives."""
    kind = F.when((F.col("label") == 1) & (F.col("decision") == 0), "fn").when((F.col("label") == 0) & (F.col("decision") == 1), "fp")
    key = F.when(F.col("kind") == "fn", F.col("score")).otherwise(-F.col("score"))
    ranked = df.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(key, "index")))
    return ranked.filter(F.col("rank") <= n).select("kind", "rank", "index", "score")


def rating_audit(df: DataFrame, rating: str) -> DataFrame:
    """Rows per label, distinct ratings and their entropy in bits."""
    c = df.groupBy("label", rating).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy("label"))
    return c.withColumn("p", F.col("c") / total).groupBy("label").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("ratings"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def leaderboard(records: DataFrame) -> DataFrame:
    """Best complete submission per team and notebook; of equal ones the first reached."""
    subs = records.groupBy("team", "notebook", "submitted_at").agg(F.bool_and("ok").alias("ok"), exact_mean(F.col("metric")).alias("value"), F.count(F.lit(1)).alias("units"))
    w = Window.partitionBy("team", "notebook").orderBy(F.desc("value"), "submitted_at")
    return subs.filter("ok").withColumn("r", F.row_number().over(w)).filter("r = 1").select("team", "notebook", "submitted_at", "value", "units")
