"""Comparing two scorers: gates, stability, pair orders, attribution and replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio, stable_digest
from .metrics import binary_metrics
from .ranks import joined, running_before, value_places

ROWS_A_TASK = 500_000  # rows of a few keys, which one task sorts and counts


def unit_deltas(a: DataFrame, b: DataFrame, by: str = "unit", metric: str = "balanced_accuracy") -> DataFrame:
    """``by, before, after, delta`` of a metric per group; NULL where it is undefined on a side."""
    left, right = (binary_metrics(x, [by]).select(by, F.col(metric).alias(name)) for x, name in ((a, "before"), (b, "after")))
    return left.join(right, by).withColumn("delta", F.col("after") - F.col("before"))


def delta_gate(deltas: DataFrame, floor: float, least_mean: float) -> DataFrame:
    """One row: units, worst and mean delta, and whether no unit falls below the floor and the mean reaches its least.

    Units without a delta are not counted; with none at all the gate does not pass.
    """
    out = deltas.agg(F.count("delta").alias("units"), F.min("delta").alias("worst"), F.avg("delta").alias("mean"))
    return out.withColumn("passed", F.coalesce((F.col("worst") >= floor) & (F.col("mean") >= least_mean), F.lit(False)))


def choose_candidate(candidates: DataFrame, passed: Column, order: list[Column], tie: float | None = None, value: str | None = None) -> DataFrame:
    """The first passing candidate in the order; with ``tie`` all within that of the best ``value`` count as equal to it."""
    kept = candidates.filter(passed)
    if tie is not None:
        best = kept.agg(F.max(value).alias("__best"))
        kept = kept.join(F.broadcast(best)).filter(F.col(value) >= F.col("__best") - tie).drop("__best")  # one row
    return kept.orderBy(*order).limit(1)


def transfer_stability(first: DataFrame, second: DataFrame, by: str = "unit") -> DataFrame:
    """Deltas of the same units on two splits: agreement of signs, share not opposed, wins and losses in both, reversals, Pearson."""
    d = first.select(by, F.col("delta").alias("x")).join(second.select(by, F.col("delta").alias("y")), by).filter("x IS NOT NULL AND y IS NOT NULL")
    x, y = F.signum("x"), F.signum("y")
    return d.agg(
        F.count(F.lit(1)).alias("units"), F.avg((x == y).cast("double")).alias("same_sign"), F.avg((x * y >= 0).cast("double")).alias("not_opposed"), F.count_if((x > 0) & (y > 0)).alias("wins"),
        F.count_if((x < 0) & (y < 0)).alias("losses"), F.count_if(x * y < 0).alias("reversals"), F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.corr("x", "y")).alias("pearson"),
    )


def _levels(df: DataFrame, by: list[str], x: str, y: str, label: str) -> DataFrame:
    """Pair counts of a group by the highest binary digit in which the ranks of x differ.

    Pairs that share all higher digits of their rank differ in x by the order of this digit, so one histogram of y for
    each (level, block) tells how many agree in y: N log N rows instead of N squared pairs. Pairs tied in x meet nowhere.
    Columns: by, and sums over all pairs x1 < x2: ``up`` (y1 < y2), ``down`` (y1 > y2), and the same for pairs of a negative
    below a positive in x (``up_np``, ``down_np``, ``np``) and of a positive below a negative (``up_pn``, ``down_pn``, ``pn``).
    """
    values = running_before(df.groupBy(*by, x).agg(F.lit(1).alias("one")), by, x, ["one"]).select(*by, x, F.col("one_before").alias("__r"))
    most = values.groupBy(*by).agg(F.max("__r").alias("__m"))
    ranked = joined(joined(df, by, values, [x]), by, most)
    bits = F.when(F.col("__m") > 0, F.floor(F.log2(F.col("__m").cast("double") + 0.5)).cast("int")).otherwise(-1)
    levels = F.when(bits >= 0, F.sequence(F.lit(0), bits)).otherwise(F.array().cast("array<int>"))
    rows = ranked.withColumn("__l", F.explode(levels))
    rows = rows.withColumn("__b", F.expr("shiftright(__r, __l + 1)")).withColumn("__s", F.expr("shiftright(__r, __l) & 1"))
    pos, hi = F.col(label) == 1, F.col("__s") == 1
    keys = [*by, "__l", "__b"]
    cells = rows.groupBy(*keys, y).agg(F.count_if(~hi & ~pos).alias("l0"), F.count_if(~hi & pos).alias("l1"), F.count_if(hi & ~pos).alias("h0"), F.count_if(hi & pos).alias("h1"))
    c = joined(running_before(cells, keys, y, ["l0", "l1"]), keys, cells.groupBy(*keys).agg(F.sum("l0").alias("tl0"), F.sum("l1").alias("tl1")))
    for name in ("l0", "l1"):
        c = c.withColumnRenamed(f"{name}_before", f"b{name}").withColumn(f"a{name}", F.col(f"t{name}") - F.col(f"b{name}") - F.col(name))
    low, high = F.col("h0") + F.col("h1"), lambda p: F.col(f"{p}l0") + F.col(f"{p}l1")
    total = lambda v: F.coalesce(F.sum(v), F.lit(0))
    return c.groupBy(*by).agg(
        total(low * high("b")).alias("up"), total(low * high("a")).alias("down"),
        total(F.col("h1") * F.col("bl0")).alias("up_np"), total(F.col("h1") * F.col("al0")).alias("down_np"), total(F.col("h1") * F.col("tl0")).alias("np"),
        total(F.col("h0") * F.col("bl1")).alias("up_pn"), total(F.col("h0") * F.col("al1")).alias("down_pn"), total(F.col("h0") * F.col("tl1")).alias("pn"),
    )


def _ties(df: DataFrame, by: list[str], keys: list[str], label: str, name: str) -> DataFrame:
    """Pairs of a group that are equal in the keys: all, and those of both labels."""
    cells = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p"))
    return cells.groupBy(*by).agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias(name), F.sum(F.col("p") * (F.col("n") - F.col("p"))).alias(f"{name}_cross"))


def pair_orders(df: DataFrame, by: list[str], x: str, y: str, label: str = "label") -> DataFrame:
    """All pair counts of a group for two scores; no pair is ever made. Rows without a score or label take no part."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(label).isNotNull())
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label) == 1).alias("positives"))
    for keys, name in (([x], "tied_x"), ([y], "tied_y"), ([x, y], "tied_both")):
        out = out.join(_ties(df, by, keys, label, name), by)
    levels = _levels(df, by, x, y, label)
    return out.join(levels, by, "left").fillna(0, [c for c in levels.columns if c not in by])


def order_agreement(df: DataFrame, by: list[str], x: str, y: str, label: str = "label") -> DataFrame:
    """Share of pairs that two scores order alike (ties in both count), over all pairs and over those of both labels; share tied in either; Kendall's tau-b."""
    c = pair_orders(df, by, x, y, label)
    n0, cross = F.col("rows") * (F.col("rows") - 1) / 2, F.col("positives") * (F.col("rows") - F.col("positives"))
    scale = F.sqrt((n0 - F.col("tied_x")) * (n0 - F.col("tied_y")))
    return c.select(
        *by, n0.cast("long").alias("pairs"), ratio(F.col("up") + F.col("tied_both"), n0).alias("agreement"), cross.alias("cross_pairs"),
        ratio(F.col("up_np") + F.col("up_pn") + F.col("tied_both_cross"), cross).alias("cross_agreement"), ratio(F.col("tied_x") + F.col("tied_y") - F.col("tied_both"), n0).alias("tie_rate"),
        F.when(scale > 0, (F.col("up") - F.col("down")) / scale).alias("tau"),
    )


def pair_complementarity(df: DataFrame, by: list[str], x: str, y: str, label: str = "label") -> DataFrame:
    """Of all (positive, negative) pairs those that x and y put in the right strict order: both, only y (recovered), only x (harmed), neither."""
    c = pair_orders(df, by, x, y, label)
    swapped = pair_orders(df, by, y, x, label).select(*by, F.col("np").alias("y_right"))
    pairs = F.col("positives") * (F.col("rows") - F.col("positives"))
    out = c.join(swapped, by).select(*by, pairs.alias("pairs"), F.col("up_np").alias("both"), (F.col("y_right") - F.col("up_np")).alias("recovered"), (F.col("np") - F.col("up_np")).alias("harmed"))
    return out.withColumn("neither", F.col("pairs") - F.col("both") - F.col("recovered") - F.col("harmed"))


def _credit(df: DataFrame, by: str, key: str, score: str, label: str, name: str) -> DataFrame:
    """Of each row the share of opposite rows it is ordered right against, ties half."""
    hist = df.groupBy(by, score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    sums = hist.groupBy(by).agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))
    placed = running_before(hist, [by], score, ["p", "n"]).join(sums, by)
    hist = placed.select(by, score, (F.col("n_before") + F.col("n") / 2).alias("pos"), (F.col("np") - F.col("p_before") - F.col("p") / 2).alias("neg"), "np", "nn")
    joined = df.select(by, key, label, score).join(hist, [by, score])
    share = F.when(F.col(label) == 1, ratio(F.col("pos"), F.col("nn"))).otherwise(ratio(F.col("neg"), F.col("np")))
    return joined.select(by, key, label, share.alias(name), "np", "nn")


def auroc_attribution(df: DataFrame, by: str, key: str, x: str, y: str, label: str = "label") -> DataFrame:
    """Of each row the mean change of its pair orders from x to y, and its part of the unit's change of AUROC, which the parts add up to."""
    a, b = _credit(df, by, key, x, label, "a"), _credit(df, by, key, y, label, "b").select(by, key, "b")
    same = F.when(F.col(label) == 1, F.col("np")).otherwise(F.col("nn"))
    out = a.join(b, [by, key]).withColumn("change", F.col("b") - F.col("a"))
    return out.select(by, key, "change", (F.col("change") / (2 * same)).alias("part"))


def content_fingerprint(df: DataFrame, key: str, columns: list[str], digits: int = 2) -> DataFrame:
    """One digest over all rows in the order of their key's digest, by buckets of its first hex digits; nulls and repeated rows count."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    rows = df.select(F.sha2(value(key), 256).alias("k"), F.sha2(F.concat_ws("\x1f", *[value(c) for c in (key, *columns)]), 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    buckets = rows.groupBy(F.left("k", F.lit(digits)).alias("bucket")).agg(joined(F.concat("k", "h")).alias("d"), F.count(F.lit(1)).alias("n"))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), joined(F.concat("bucket", "d")).alias("digest"))


def order_changes(df: DataFrame, by: str, key: str, x: str, y: str) -> DataFrame:
    """Rows of a unit whose place by x (ties by key) is another by y."""
    both = value_places(value_places(df.select(by, key, x, y), [by], -F.col(x), [key], "__a"), [by], -F.col(y), [key], "__b", "__m")
    return both.select(by, (F.col("__a") != F.col("__b")).alias("moved")).groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count_if("moved").alias("moved"))


def prefix_replay(df: DataFrame, text: str, caps: list[int], decide) -> DataFrame:
    """Had each text been cut at n characters: rows whose decision stays, and the share of characters saved, per cap."""
    cut = df.filter(F.col(text).isNotNull()).withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps])))
    short, whole = F.col(text).substr(F.lit(1), F.col("cap")), F.length(text)
    rows = cut.select("cap", decide(F.col(text)).alias("full"), decide(short).alias("replayed"), whole.alias("n"), F.greatest(F.lit(0), whole - F.col("cap")).alias("saved"))
    return rows.groupBy("cap").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("full").eqNullSafe(F.col("replayed"))).alias("kept"), ratio(F.sum("saved"), F.sum("n")).alias("saved"))


def admit_categories(deltas: DataFrame, source_deltas: DataFrame, by: str, floor: float, source_floor: float) -> DataFrame:
    """``semantic`` where a category gains the floor and none of its sources falls below theirs, ``ordinary`` where it does not lose, else ``none``."""
    worst = source_deltas.groupBy(by).agg(F.min("delta").alias("worst_source"))
    out = deltas.join(worst, by, "left")
    admitted = F.when((F.col("delta") >= floor) & (F.coalesce("worst_source", F.lit(0.0)) >= source_floor), "semantic").when(F.col("delta") >= 0, "ordinary").otherwise("none")
    return out.select(by, "delta", "worst_source", admitted.alias("admit"))


def repeat_consistency(df: DataFrame, group: list[str], fact: list[str], row: str, label: str, neutral: str) -> DataFrame:
    """Over pairs of rows of a group that label the same fact: equal labels, equally decisive, and in conflict (both decisive, unequal).

    Counted from the label counts of each fact, so a fact of many rows makes no pairs. One label a row and fact: the least.
    Tasks take about ``ROWS_A_TASK`` rows each, however many there are: rows are dealt by fact and a hash ``__s`` of the row, which spreads a fact of
    many rows, and their counts by fact. Aggregates then need no other shuffle.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    dealt = df.select(*group, *fact, row, label, F.pmod(F.xxhash64(row), F.lit(tasks)).alias("__s")).repartition(tasks, *group, *fact, "__s")
    one = dealt.groupBy(*group, *fact, "__s", row).agg(F.min(label).alias("label"))
    parts = one.groupBy(*group, *fact, "__s", "label").agg(F.count(F.lit(1)).alias("n")).drop("__s")
    cells = parts.repartition(tasks, *group, *fact).groupBy(*group, *fact, "label").agg(F.sum("n").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    decisive = F.sum(F.when(F.col("label") != neutral, F.col("n")).otherwise(0))
    total = F.sum("n")
    same_decisive = F.sum(F.when(F.col("label") != neutral, pairs(F.col("n"))).otherwise(0))
    facts = cells.groupBy(*group, *fact).agg(pairs(total).alias("pairs"), F.sum(pairs(F.col("n"))).alias("equal"), (pairs(decisive) + pairs(total - decisive)).alias("alike"), (pairs(decisive) - same_decisive).alias("conflicts"))
    return facts.groupBy(*group).agg(*[F.sum(c).cast("long").alias(c) for c in ("pairs", "equal", "alike", "conflicts")]).filter("pairs > 0")


