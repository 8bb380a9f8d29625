"""Document fingerprints: a homomorphic multiset hash of paragraphs, in SQL functions only.

Every non-empty line is hashed to a wide vector; the fingerprint is the sum of the
vectors modulo powers of two. Sums do not depend on order, and a line is inserted
or deleted by adding or subtracting its vector (``add`` and ``remove``).
The vector has a count, 16 dense lanes modulo 2**32 that decide equality, and 32
sparse lanes modulo 2**16 of which a line touches one: lanes left equal by two
texts tell how many of their lines differ (``likeness``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DENSE, SPARSE = 16, 32
LEVELS, STEP, LANES, LEAST_EQUAL = 8, 4, 64, 16
_QUANTILES, _MOST_RANGES = 64, 1024


def lane_moduli() -> list[int]:
    return [2**32] + [2**32] * DENSE + [2**16] * SPARSE


def line_hashes(text: Column) -> Column:
    """Of each non-empty line: its 16 dense lanes, the sparse lane that it touches, and by how much."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: p != "")
    hashed = F.transform(lines, lambda p: F.concat(F.sha2(F.concat(F.lit("a"), p), 256), F.sha2(F.concat(F.lit("b"), p), 256)))
    number = lambda w, at, n: F.conv(F.substring(w, at, n), 16, 10).cast("long")
    return F.transform(
        hashed,
        lambda w: F.struct(F.array(*[number(w, 8 * k + 1, 8) for k in range(DENSE)]).alias("d"), F.pmod(number(w, 1, 8), F.lit(SPARSE)).cast("int").alias("k"), number(w, 9, 4).bitwiseOR(F.lit(1)).alias("v")),
    )


def vector(hashes: Column) -> Column:
    """ARRAY<BIGINT> of the 1 + 16 + 32 lanes of a column of ``line_hashes``; no lines give the zero vector."""
    zero = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    dense = F.aggregate(hashes, zero(DENSE), lambda acc, e: F.zip_with(acc, e["d"], lambda x, y: (x + y) % F.lit(2**32)))
    sparse = F.aggregate(hashes, zero(SPARSE), lambda acc, e: F.transform(acc, lambda x, i: F.when(i == e["k"], (x + e["v"]) % F.lit(2**16)).otherwise(x)))
    return F.concat(F.array(F.size(hashes).cast("long")), dense, sparse)


def level_moduli() -> list[int]:
    return [2**32] * (1 + DENSE) + [2**16] * (LEVELS * LANES)


def leveled_vector(hashes: Column) -> Column:
    """The count, 16 dense lanes, and ``LANES`` sparse lanes at each of ``LEVELS`` levels; a level has one in ``STEP`` lines of the level before."""
    zero = F.array_repeat(F.lit(0).cast("long"), LANES)
    put = lambda acc, e: F.transform(acc, lambda x, i: F.when(i == e["d"][0] % LANES, (x + e["v"]) % F.lit(2**16)).otherwise(x))
    sampled = lambda n: F.filter(hashes, lambda e: e["d"][2] % F.lit(n) == 0)
    levels = [F.aggregate(sampled(STEP**k), zero, put) for k in range(LEVELS)]
    return F.concat(F.slice(vector(hashes), 1, DENSE + 1), *levels)


def equal_lanes(a: Column, b: Column) -> Column:
    """Of two leveled vectors: how many sparse lanes are equal at each level."""
    lanes = lambda x, k: F.slice(x, DENSE + 2 + k * LANES, LANES)
    return F.array(*[F.aggregate(F.zip_with(lanes(a, k), lanes(b, k), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) for k in range(LEVELS)])


def leveled_likeness(a: Column, b: Column, same: Column) -> Column:
    """``likeness`` of two leveled vectors and their ``equal_lanes``, at every length.

    Differing lines are estimated at the first level with at least ``LEAST_EQUAL`` equal lanes, else at the last;
    where that has none, all lines differ. At least as many differ as the counts do.
    """
    total, apart = F.element_at(a, 1) + F.element_at(b, 1), F.abs(F.element_at(a, 1) - F.element_at(b, 1))
    lines = lambda k: -F.lit(float(LANES * STEP**k)) * F.log(same[k].cast("double") / LANES)
    differ = F.coalesce(*[F.when(same[k] >= LEAST_EQUAL, lines(k)) for k in range(LEVELS)], F.when(same[LEVELS - 1] > 0, lines(LEVELS - 1)), total.cast("double"))
    equal = F.slice(a, 1, DENSE + 1) == F.slice(b, 1, DENSE + 1)
    return F.when(equal, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.greatest(differ, apart.cast("double")) / total))


def _lanewise(a: Column, b: Column, sign: int, moduli: list[int] | None = None) -> Column:
    moduli = F.array(*[F.lit(m).cast("long") for m in moduli or lane_moduli()])
    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y"), moduli.alias("m")), lambda z: F.pmod(z["x"] + F.lit(sign) * z["y"], z["m"]))


def add(a: Column, b: Column, moduli: list[int] | None = None) -> Column:
    """The vector of the union of two multisets of lines."""
    return _lanewise(a, b, 1, moduli)


def remove(a: Column, b: Column, moduli: list[int] | None = None) -> Column:
    """The vector of a multiset less the lines of another."""
    return _lanewise(a, b, -1, moduli)


def fingerprint(lanes: Column) -> Column:
    """The lanes as one hexadecimal string, most significant digit first within each lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one less the share of lines estimated to differ; 1 exactly where the dense lanes and counts agree."""
    same = F.aggregate(F.zip_with(F.slice(a, DENSE + 2, SPARSE), F.slice(b, DENSE + 2, SPARSE), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    differ = -F.lit(float(SPARSE)) * F.log(F.greatest(same.cast("double"), F.lit(0.5)) / SPARSE)
    total = F.element_at(a, 1) + F.element_at(b, 1)
    equal = F.slice(a, 1, DENSE + 1) == F.slice(b, 1, DENSE + 1)
    return F.when(equal, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - differ / total))


def _choice(cuts: list[int], lo: int, hi: int) -> Column:
    """How many cuts lie below doc_id, as nested binary choices."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col("doc_id") > F.lit(cuts[mid]), _choice(cuts, mid + 1, hi)).otherwise(_choice(cuts, lo, mid))


def _ranges(docs: DataFrame, n_ranges: int) -> Column:
    """Range number of a doc_id, ascending with it: quantile cuts, each divided evenly by value."""
    coarse = max(1, min(_QUANTILES, n_ranges))
    least, most, cuts = docs.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [k / coarse for k in range(1, coarse)] or [0.5], 10_000)).first()
    if least is None:
        return F.lit(0)
    cuts = sorted({int(c) for c in cuts} - {most})
    lows, highs = [least, *[c + 1 for c in cuts]], [*cuts, most]
    fine = max(1, n_ranges // len(lows))
    c = _choice(cuts, 0, len(cuts))
    low, high = (F.element_at(F.array(*[F.lit(x).cast("double") for x in xs]), c + 1) for xs in (lows, highs))
    part = F.floor((F.col("doc_id").cast("double") - low) / (high - low + 1) * fine)
    return F.coalesce((c * fine + F.greatest(F.lit(0), F.least(part, F.lit(fine - 1)))).cast("int"), F.lit(0))


def with_next(df: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: the text of the next document in ascending doc_id, after the last the first.

    A null doc_id stands first; ties stand in the order of a hash of their text. The order is cut into at most
    ``_MOST_RANGES`` ranges; each is one window, to which a copy of the next range's first row is added, so texts
    are shuffled once. A window streams its sorted rows; rows that share one doc_id stay in one range.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_ranges = min(_MOST_RANGES, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    placed = docs.select("doc_id", "text", _ranges(docs, n_ranges).alias("b"), F.xxhash64("text").alias("h"), F.lit(0).alias("g"))
    firsts = placed.select("b", key.alias("k"), "h").groupBy("b").agg(F.min(F.struct("k", "h")).alias("m")).select("b", "m.k", "m.h").orderBy("b").collect()  # a row a range
    if not firsts:
        return placed.select("doc_id", "text", F.col("text").alias("next_text"))
    values = ", ".join(f"({r['k']}L, {r['h']}L, {firsts[i - 1]['b']}, {1 if i else 2})".replace("(-9223372036854775808L", "(bigint('-9223372036854775808')").replace(" -9223372036854775808L", " bigint('-9223372036854775808')") for i, r in enumerate(firsts))
    heads = df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(k, h, b, g)")
    copies = placed.select("doc_id", "text", "h", key.alias("k")).join(F.broadcast(heads), ["k", "h"]).dropDuplicates(["k", "h"]).select("doc_id", "text", "b", "h", "g")
    order = Window.partitionBy("b").orderBy(F.col("g") == 2, F.col("doc_id").asc_nulls_first(), "h")
    return placed.unionByName(copies).withColumn("next_text", F.lead("text").over(order)).filter("g = 0").select("doc_id", "text", "next_text")


def edited_text(n_chars: Column) -> Column:
    """Of ``with_next``: the text with its last floor(n/4) code points replaced by the first as many of the next document."""
    k = F.floor(n_chars / 4).cast("int")
    return F.concat(F.col("text").substr(F.lit(1), (n_chars - k).cast("int")), F.col("next_text").substr(F.lit(1), k))


def fingerprint_documents(df: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row.

    The edited text is the text with its last quarter replaced from the next document. Null texts count as
    empty and have the zero vector; two empty texts are alike by 1. Repeated rows each give a row. An empty
    table gives none.
    """
    texts = with_next(df).withColumn("n_chars", F.length("text").cast("long"))
    texts = texts.withColumn("edited", edited_text(F.col("n_chars")))
    # Each column is made in a step of its own: one expression would be evaluated again wherever it is used.
    hashed = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), line_hashes(F.col("text")).alias("own"), line_hashes(F.col("edited")).alias("ed"), line_hashes(F.col("next_text")).alias("nx"))
    lanes = hashed.select("doc_id", "n_chars", "edited_sha256", *[vector(F.col(c)).alias(c) for c in ("own", "ed", "nx")])
    return lanes.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("ed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("ed")).alias("near_edited"), likeness(F.col("own"), F.col("nx")).alias("near_next"),
    )


def line_likeness(df: DataFrame) -> DataFrame:
    """``doc_id, n_lines, near_edited, near_next`` per row: the likenesses of ``fingerprint_documents``, at every length."""
    texts = with_next(df).withColumn("edited", edited_text(F.length("text").cast("long")))
    hashed = texts.select("doc_id", *[line_hashes(F.col(c)).alias(name) for c, name in (("text", "own"), ("edited", "ed"), ("next_text", "nx"))])
    lanes = hashed.select("doc_id", *[leveled_vector(F.col(c)).alias(c) for c in ("own", "ed", "nx")])
    own, ed, nx = (F.col(c) for c in ("own", "ed", "nx"))
    same = lanes.select("*", equal_lanes(own, ed).alias("same_ed"), equal_lanes(own, nx).alias("same_nx"))
    return same.select("doc_id", F.element_at(own, 1).alias("n_lines"), leveled_likeness(own, ed, F.col("same_ed")).alias("near_edited"), leveled_likeness(own, nx, F.col("same_nx")).alias("near_next"))
