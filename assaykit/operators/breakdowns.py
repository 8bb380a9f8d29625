"""Finer tables of the metrics: by scenario and pooled, ties and quantiles, sides, votes, ratings, strata, fusions and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .metrics import auroc, binary_metrics
from .ranks import value_places


def breakdowns(df: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """``kind, name, recall, fpr, balanced_accuracy, auroc, units``: means over the defined units, for each value of each column, and over all; and all rows pooled.

    The units of a breakdown are (value, unit) cells. A NULL value is a row of its own.
    """
    names = ["recall", "fpr", "balanced_accuracy", "auroc"]

    def scored(keys: list[str]) -> DataFrame:
        a, b = binary_metrics(df, keys), auroc(df, keys).withColumnsRenamed({k: f"__{k}" for k in keys})
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        return a.join(b, on).drop(*[f"__{k}" for k in keys])

    parts = [scored([unit]).groupBy(F.lit("macro").alias("kind"), F.lit(None).cast("string").alias("name")).agg(*[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("units"))]
    for column in by:
        parts.append(scored([column, unit]).groupBy(F.lit(column).alias("kind"), F.col(column).cast("string").alias("name")).agg(*[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("units")))
    pooled = df.withColumn("__all", F.lit("all"))
    both = binary_metrics(pooled, ["__all"]).join(auroc(pooled, ["__all"]), "__all")
    parts.append(both.select(F.lit("pooled").alias("kind"), F.lit(None).cast("string").alias("name"), *names, F.lit(1).cast("long").alias("units")))
    return reduce(DataFrame.unionByName, parts)


def smallest_cell(cells: DataFrame, value: str, size: str, least: int) -> DataFrame:
    """One row: cells of at least so many rows, and the least value among them with the smallest size of its ties."""
    kept = cells.filter(F.col(size) >= least)
    return kept.agg(F.count(F.lit(1)).alias("cells"), F.min(value).alias("least"), F.min_by(size, F.struct(F.col(value), F.col(size))).alias("rows"))


def tie_diagnostics(df: DataFrame, unit: str) -> DataFrame:
    """Per unit the share of (positive, negative) pairs with equal scores, and nine deciles of the score."""
    hist = df.groupBy(unit, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    ties = hist.groupBy(unit).agg(F.sum(F.col("p") * F.col("n")).alias("ties"), (F.sum("p") * F.sum("n")).alias("pairs"))
    q = df.groupBy(unit).agg(F.percentile("score", F.array(*[F.lit(k / 10) for k in range(1, 10)])).alias("q"))
    return ties.join(q, unit).select(unit, ratio(F.col("ties"), F.col("pairs")).alias("cross_ties"), *[F.col("q")[k].alias(f"d{k + 1}") for k in range(9)])


def fit_errors(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Root mean square of the residuals of the least-squares line, from sums alone: sqrt((Syy - Sxy^2 / Sxx) / n)."""
    s = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"))
    return s.select(by, "n", F.when(F.col("sxx") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / F.col("n"))).alias("rmse"))


def parity_counts(df: DataFrame, by: str, a: str, b: str, middle: float = 0.5) -> DataFrame:
    """Share of rows on the same side of the middle (equal to it counts as its own side), and exact equals."""
    side = lambda c: F.signum(F.col(c) - middle)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((side(a) == side(b)).cast("double")).alias("same_side"), F.count_if(F.col(a) == F.col(b)).alias("exact"))


def teacher_sides(df: DataFrame, teacher: str) -> DataFrame:
    """By label and whether the teacher is right: rows, and those on which the student errs."""
    return df.groupBy("label", (F.col(teacher) == F.col("label")).alias("teacher_right")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") != F.col("label")).alias("errors"))


def vote_scores(members: DataFrame, size: int) -> DataFrame:
    """Mean, median, least and greatest score of complete ensembles (``index, member, score``); incomplete ones are left out."""
    g = members.groupBy("index").agg(F.count_distinct("member").alias("n"), F.avg("score").alias("mean"), F.percentile("score", F.lit(0.5)).alias("median"), F.min("score").alias("least"), F.max("score").alias("most"))
    return g.filter(F.col("n") == size).drop("n")


def rating_counts(df: DataFrame, rating: str, low: int, high: int) -> DataFrame:
    """``rating, label, n, share, intermediate``: rows of each rating and label, their share of the label, and whether the rating lies strictly between the ends."""
    c = df.groupBy(rating, "label").agg(F.count(F.lit(1)).alias("n"))
    totals = df.groupBy(F.col("label").alias("__l")).agg(F.count(F.lit(1)).alias("t"))
    return c.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("__l"))).select(rating, "label", "n", (F.col("n") / F.col("t")).alias("share"), ((F.col(rating) > low) & (F.col(rating) < high)).alias("intermediate"))


def joint_status(df: DataFrame, flags: list[str], uses: list[tuple[str, str]]) -> DataFrame:
    """Rows of every combination of the flags, and the use of the first rule (SQL condition) that holds for it; ``review`` where none does."""
    use = F.lit("review")
    for condition, name in reversed(uses):
        use = F.when(F.expr(condition), name).otherwise(use)
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n")).withColumn("use", use)


def map_totals(df: DataFrame, by: list[str], usage: Column) -> DataFrame:
    """Sums of every key of a map of numbers; NULL maps and values count for nothing."""
    rows = df.select(*by, F.explode(usage).alias("key", "value"))
    return rows.groupBy(*by, "key").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


def centred_correlation(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """One row: the Pearson correlation of two columns after each is centred in its group, next to that of the raw columns."""
    means = df.groupBy(by).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    j = df.join(means, by).select(x, y, (F.col(x) - F.col("__mx")).alias("rx"), (F.col(y) - F.col("__my")).alias("ry"))
    return j.agg(F.corr(x, y).alias("raw"), F.corr("rx", "ry").alias("within"), F.count(F.lit(1)).alias("rows"))


def worst_units(df: DataFrame, unit: str, n: int) -> DataFrame:
    """The n units of the lowest balanced accuracy, with their rows that have no decision (parse errors); units without both classes are not ranked."""
    errors = df.groupBy(unit).agg(F.count_if(F.col("decision").isNull()).alias("unparsed"))
    m = binary_metrics(df.filter("decision IS NOT NULL"), [unit]).select(unit, "balanced_accuracy").join(errors, unit).filter("balanced_accuracy IS NOT NULL")
    return m.orderBy(F.round("balanced_accuracy", 9), unit).limit(n)


def reciprocal_fusion(tables: list[DataFrame], unit: str, key: str, k: int = 60) -> DataFrame:
    """``key, fused``: the sum over rankings of 1 / (k + place), places by score in the unit, ties by key."""
    parts = [value_places(t.select(unit, key, "score"), [unit], -F.col("score"), [key]).select(key, (1.0 / (k + F.col("__r"))).alias("rr")) for t in tables]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("rr").alias("fused"))


def scored_windows(windows: DataFrame, key: str, place: str, size: str, relevance: Column, quota: int, penalty: float = 0.02) -> DataFrame:
    """Of the windows of each text and size the ``quota`` most relevant, less a penalty for each sentence beyond the first; equal ones by place."""
    rows = windows.withColumn("relevance", F.round(relevance - penalty * (F.col(size) - 1), 6))
    w = Window.partitionBy(key, size).orderBy(F.desc("relevance"), place)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= quota)


def coverage_reasons(a: DataFrame, b: DataFrame, key: str, reason: str) -> DataFrame:
    """``relation, reason, n``: keys in both tables, only in the first, only in the second, the latter two by the reason that their row gives."""
    x = a.groupBy(key).agg(F.min(reason).alias("ra"), F.lit(True).alias("a"))
    y = b.groupBy(key).agg(F.min(reason).alias("rb"), F.lit(True).alias("b"))
    kind = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_first").otherwise("only_second")
    why = F.when(F.col("a") & F.col("b"), F.lit(None)).otherwise(F.coalesce("ra", "rb"))
    return x.join(y, key, "full_outer").groupBy(kind.alias("relation"), why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def rule_audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rule, violations`` for any number of conditions that no row should meet; a NULL condition is no violation."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def member_targets(df: DataFrame, key: str, size: int, probability: str, label: str) -> DataFrame:
    """``key, winner, problem``: the member of the highest score of each key; ``problem`` names a wrong number of members, probabilities off a sum of 1, or labels that differ."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(probability).cast("decimal(28,12)")).alias("mass"), F.min(label).alias("lo"), F.max(label).alias("hi"), F.max_by("member", F.struct(F.col(probability), -F.col("member"))).alias("winner"))
    problem = F.when(F.col("n") != size, "members").when(F.abs(F.col("mass") - 1) > 1e-9, "mass").when(F.col("lo") != F.col("hi"), "labels")
    return g.select(key, F.when(problem.isNull(), F.col("winner")).alias("winner"), problem.alias("problem"))


def views_of_dialogue(turns: DataFrame) -> DataFrame:
    """``conv_id, user, assistant, first_user, last_user``: the texts of a conversation by role, and the first and last user turns; empty where there is none."""
    text = F.coalesce("text", F.lit(""))
    of = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", text.alias("text"))))), lambda x: x["text"]), "\n")
    edge = lambda f, role: F.coalesce(f(F.when(F.col("role") == role, F.struct("turn", text.alias("text"))))["text"], F.lit(""))
    return turns.groupBy("conv_id").agg(of("user").alias("user"), of("assistant").alias("assistant"), edge(F.min, "user").alias("first_user"), edge(F.max, "user").alias("last_user"))


def sanitised_condition(turns: DataFrame, pattern: str, marker: str = "[removed]") -> DataFrame:
    """The turns with every match of a pattern replaced: the third condition beside the original and the one without a role."""
    return turns.withColumn("text", F.regexp_replace("text", pattern, marker))


def exclusive_routes(df: DataFrame, rules: list[tuple[str, Column]], key: str) -> DataFrame:
    """``route, n, overlaps``: rows by the first rule that holds (rules may look at any columns but the label), and how many of them a later rule would also take."""
    held = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    rows = df.select(key, held.alias("h"))
    return rows.groupBy(F.coalesce(F.try_element_at("h", F.lit(1)), F.lit("none")).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("h") > 1).alias("overlaps"))


def recovered_rows(ranked: DataFrame, claim: str, row: Column, ks: list[int]) -> DataFrame:
    """One row: rows of which any claim's first match has a rank of at most k."""
    first = ranked.groupBy(row.alias("row")).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return first.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("first") <= k).alias(f"at_{k}") for k in ks])


