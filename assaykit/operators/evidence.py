"""Evidence of claims: aggregation, utility, selectors, candidate picks, and orders and batches of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio, stable_digest
from ..functions.text import verdict
from .ranks import digest_places, value_places


def aggregate_evidence(df: DataFrame, claim: str, place: str, k: int, least: float) -> DataFrame:
    """Of each claim's k candidates of most non-neutral mass: the strongest support and refutation, the verdict and its confidence.

    Columns ``support, contradict, neutral`` hold the masses; the neutral mass of a claim is the least of its kept candidates.
    """
    w = Window.partitionBy(claim).orderBy(F.desc(F.col("support") + F.col("contradict")), place)
    kept = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    out = kept.groupBy(claim).agg(F.count(F.lit(1)).alias("kept"), F.max("support").alias("support"), F.max("contradict").alias("contradict"), F.min("neutral").alias("neutral"))
    return out.select(claim, "kept", "support", "contradict", verdict(F.col("support"), F.col("neutral"), F.col("contradict"), least).alias("verdict"), F.greatest("support", "contradict").alias("confidence"))


def verdict_report(df: DataFrame, condition: str, verdict_col: str, truth: str, abstain: str = "NOT_ENOUGH_INFO") -> DataFrame:
    """Per condition: rows, decisions of each kind, share that decides, and agreement with the truth where decided."""
    v = F.col(verdict_col)
    polar = v != abstain
    return df.groupBy(condition).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(v == "SUPPORTS").alias("supports"), F.count_if(v == "REFUTES").alias("refutes"), F.avg(F.when(polar, 0.0).otherwise(1.0)).alias("abstained"),
        ratio(F.count_if(polar & (v == F.col(truth))), F.count_if(polar)).alias("agreement"),
    )


def paired_verdicts(real: DataFrame, shuffled: DataFrame, claim: str, truth: str) -> DataFrame:
    """One row: claims that only the real or only the shuffled evidence decides rightly, both and neither."""
    a = real.select(claim, (F.col("verdict") == F.col(truth)).alias("a"))
    b = shuffled.select(claim, (F.col("verdict") == F.col(truth)).alias("b"))
    return a.join(b, claim).agg(F.count_if(F.expr("a AND b")).alias("both"), F.count_if(F.expr("a AND NOT b")).alias("real_only"), F.count_if(F.expr("b AND NOT a")).alias("shuffled_only"), F.count_if(F.expr("NOT a AND NOT b")).alias("neither"))


def utility(df: DataFrame, real: str, empty: str, shuffled: str) -> DataFrame:
    """All columns plus ``gain`` (log probability with evidence minus without) and ``net`` (gain minus that of shuffled evidence)."""
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1e-12)))
    return df.withColumn("gain", log(real) - log(empty)).withColumn("net", log(real) - log(shuffled))


def utility_summary(df: DataFrame, row: str, real: str, empty: str) -> DataFrame:
    """One row over all candidates: mean, median and positive share of the gain, rescues and harms at 0.5, mean of each row's best gain."""
    best = df.groupBy(row).agg(F.max("gain").alias("best")).agg(F.avg("best").alias("ceiling"), F.count(F.lit(1)).alias("rows"))
    rescued, harmed = (F.col(empty) < 0.5) & (F.col(real) >= 0.5), (F.col(empty) >= 0.5) & (F.col(real) < 0.5)
    out = df.agg(F.count(F.lit(1)).alias("candidates"), F.avg("gain").alias("mean"), F.percentile("gain", F.lit(0.5)).alias("median"), F.avg((F.col("gain") > 0).cast("double")).alias("positive"), F.avg("net").alias("net"), F.count_if(rescued).alias("rescues"), F.count_if(harmed).alias("harms"))
    return out.join(F.broadcast(best))  # one row each


def compare_selectors(df: DataFrame, claim: str, place: str, selectors: dict[str, Column], relevant: Column) -> DataFrame:
    """``selector, picked, precision, recall``: each selector takes a claim's first candidate that it accepts."""
    marked = df.select(claim, place, relevant.alias("__rel"), *[c.alias(n) for n, c in selectors.items()])
    picks = marked.groupBy(claim).agg(F.max(F.col("__rel").cast("int")).alias("any"), *[F.min_by(F.col("__rel").cast("int"), F.when(F.col(n), F.col(place))).alias(n) for n in selectors])
    sums = picks.agg(F.sum("any").alias("any"), *[x for n in selectors for x in (F.count(n).alias(f"{n}_n"), F.sum(n).alias(f"{n}_hit"))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("selector"), F.col(f"{n}_n").alias("picked"), ratio(F.col(f"{n}_hit"), F.col(f"{n}_n")).alias("precision"), ratio(F.col(f"{n}_hit"), F.col("any")).alias("recall")) for n in selectors]))
    return sums.select(rows.alias("r")).select("r.*")


def selection_report(df: DataFrame, row: str, candidate: str, score: str, label: str, decision: str, baseline: str, threshold: float) -> DataFrame:
    """One row: each row takes its best candidate's decision if that scores the threshold, else its baseline; coverage, helps, harms and both accuracies."""
    best = df.groupBy(row).agg(F.max(F.struct(F.col(score).alias("s"), F.negate(F.col(candidate)).alias("c"), F.col(decision).alias("d"))).alias("b"), F.min(label).alias("y"), F.min(baseline).alias("base"))
    chosen = F.when(F.col("b.s") >= threshold, F.col("b.d")).otherwise(F.col("base"))
    rows = best.select("y", "base", chosen.alias("d"), (F.col("b.s") >= threshold).alias("used"))
    right, before = F.col("d") == F.col("y"), F.col("base") == F.col("y")
    side = lambda k: F.avg(F.when(F.col("y") == k, right.cast("double") - before.cast("double")))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col("used").cast("double")).alias("coverage"), F.count_if(right & ~before).alias("helped"), F.count_if(before & ~right).alias("harmed"),
        ratio(F.count_if(before & ~right), F.count_if("used")).alias("harm_rate"), F.avg(before.cast("double")).alias("before"), F.avg(right.cast("double")).alias("after"), ((side(0) + side(1)) / 2).alias("balanced_gain"),
    )


def search_mappings(df: DataFrame, relation: str, predicate: str, half: Column, covered: Column, hit: Column) -> DataFrame:
    """Per relation and predicate in both halves of the rows: coverage, hits, and the lesser of the two precisions, the best mappings first by it."""
    h0, h1 = half == 0, half == 1
    part = lambda h, c: F.count_if(h & c)
    out = df.groupBy(relation, predicate).agg(*[x for i, h in enumerate((h0, h1)) for x in (part(h, covered).alias(f"covered_{i}"), part(h, covered & hit).alias(f"hits_{i}"))])
    worse = F.least(*[F.coalesce(ratio(F.col(f"hits_{i}"), F.col(f"covered_{i}")), F.lit(0.0)) for i in (0, 1)])
    return out.withColumn("worse_precision", worse).withColumn("place", F.row_number().over(Window.partitionBy(relation).orderBy(F.desc("worse_precision"), F.desc(F.col("hits_0") + F.col("hits_1")), predicate)))


def pick_candidate(df: DataFrame, row: str, gain: str, decisive: str, size: str, candidate: str, g: float, topical: str | None = None) -> DataFrame:
    """Per row: the most harmful candidate (below -g, not decisive), the most helpful (above g), and the rejected one that is shortest; NULL where there is none.

    With a ``topical`` column (0 or 1) rejected candidates that are topical go before the shorter ones.
    """
    y = F.col(gain)
    pick = lambda order, ok: F.min_by(candidate, F.when(ok, order))
    first = [] if topical is None else [1 - F.coalesce(topical, F.lit(0))]
    return df.groupBy(row).agg(
        pick(F.struct(y, F.col(candidate)), (y < -g) & (F.col(decisive) == 0)).alias("harmful"), pick(F.struct(-y, F.col(candidate)), y > g).alias("helpful"),
        pick(F.struct(*first, F.col(size), F.col(candidate)), F.abs(y) <= g).alias("rejected"),
    )


def hard_negatives(df: DataFrame, row: str, candidate: str, decisive: str, chosen: str, kind: str, popularity: str, n: int, kinds: list[str]) -> DataFrame:
    """``row, place, candidate``: the first n candidates that are not decisive: wrongly chosen ones, then by the order of kinds (others and NULL last),
    the more popular, and the smaller id. Rows of many candidates are cut to n before they are shuffled."""
    after = F.coalesce(*[F.when(F.col(kind) == k, i) for i, k in enumerate(kinds)], F.lit(len(kinds)))
    order = [F.desc(F.coalesce(F.col(chosen), F.lit(0))), after, F.desc(F.coalesce(F.col(popularity), F.lit(0))), candidate]
    place = F.row_number().over(Window.partitionBy(row).orderBy(*order))
    return df.filter(F.coalesce(F.col(decisive), F.lit(0)) == 0).withColumn("place", place).filter(F.col("place") <= n).select(row, "place", candidate)


def balanced_contradictions(df: DataFrame, key: str, contradicted: str, label: str = "label", seed: str = "contradiction") -> DataFrame:
    """``key, variant``: by digest as many contradicted rows of label 0 (``ordinary_error``) as of label 1 (``deception``); rows without a label have none."""
    ranked = digest_places(df.filter((F.col(contradicted) == 1) & F.col(label).isin(0, 1)).select(key, label), [label], seed, key, "i")
    mates = df.agg(*[F.count_if((F.col(contradicted) == 1) & (F.col(label) == k)).alias(f"n{k}") for k in (0, 1)])
    kept = ranked.join(F.broadcast(mates)).filter(F.col("i") <= F.least("n0", "n1"))  # one row
    return kept.select(key, F.when(F.col(label) == 0, "ordinary_error").otherwise("deception").alias("variant"))


def focus_passages(df: DataFrame, claim: str, place: str, relevance: Column) -> DataFrame:
    """The most relevant sentence of each claim, the first of equal ones."""
    return df.withColumn("relevance", relevance).groupBy(claim).agg(F.max_by(F.struct(place, "relevance"), F.struct(F.col("relevance"), -F.col(place))).alias("s")).select(claim, f"s.{place}", "s.relevance")


def single_claim(df: DataFrame, row: str, claim: str) -> DataFrame:
    """Only the rows of the least claim of each row."""
    return df.withColumn("__m", F.min(claim).over(Window.partitionBy(row))).filter(F.col(claim) == F.col("__m")).drop("__m")


def pair_rows(df: DataFrame, unit: str, key: str, label: str = "label", seed: str = "pair") -> DataFrame:
    """``key, block, within``: opposite labels of a unit as neighbours in one block (within 0 and 1), what is left over as blocks of one (within 0).

    ``block`` is a digest, so sorting by (block, within) gives every row exactly once with its partner beside it.
    """
    ranked = digest_places(df.select(unit, key, label), [unit, label], seed, key, "i")
    mates = df.groupBy(unit).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    paired = F.col("i") <= F.least("p", "n")
    block = F.when(paired, stable_digest(seed, unit, "i")).otherwise(stable_digest(seed + "-alone", key))
    return ranked.join(mates, unit).select(key, block.alias("block"), F.when(paired, F.col(label)).otherwise(0).alias("within"))


def block_order(df: DataFrame, unit: str, key: str, batch: int, label: str = "label", seed: str = "block") -> DataFrame:
    """``key, kind, block``: blocks of batch/2 rows of each label of a unit (full), what is left of the units (rest)."""
    half = batch // 2
    ranked = digest_places(df.select(unit, key, label), [unit, label], seed, key, "i").withColumn("i", F.col("i") - 1)
    mates = df.groupBy(unit).agg((F.least(F.floor(F.count_if(F.col(label) == 1) / half), F.floor(F.count_if(F.col(label) == 0) / half)) * half).alias("full"))
    number = F.floor(F.col("i") / half)
    return ranked.join(mates, unit).select(key, F.when(F.col("i") < F.col("full"), "full").otherwise("rest").alias("kind"), F.when(F.col("i") < F.col("full"), F.concat_ws(":", unit, number.cast("string"))).alias("block"))
