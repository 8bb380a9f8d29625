"""Reproducible samples, splits and orders by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import stable_digest
from .ranks import digest_places, value_places


def sample_fraction(df: DataFrame, fraction: float, strata: list[str], seed: str = "s", key: str = "index") -> DataFrame:
    """max(1, int(n f + 0.5)) rows of each stratum, the first by the digest of their key (ties by the key); an empty table gives none."""
    return digest_places(df, strata, seed, key).filter(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * fraction + 0.5))).drop("__r", "__n")


def split3(df: DataFrame, ratios: tuple[float, float, float], strata: list[str], seed: str = "split", key: str = "index") -> DataFrame:
    """train/dev/test by largest remainders; a stratum of three rows or more keeps every split."""
    x = digest_places(df, strata, seed, key)
    exact = [F.round(F.col("__n") * r, 9) for r in ratios]
    low = [F.floor(e) for e in exact]
    spare = F.col("__n") - (low[0] + low[1] + low[2])
    rest = [e - b for e, b in zip(exact, low, strict=True)]
    c = []
    for i in range(3):
        ahead = F.lit(0)
        for j in range(3):
            if j != i:
                ahead = ahead + ((rest[j] > rest[i]) | ((rest[j] == rest[i]) & F.lit(j < i))).cast("int")
        c.append((low[i] + (ahead < spare).cast("int")).alias(f"__c{i}"))
    x = x.select("*", *c)
    for i in (1, 2):  # borrow from the first, the largest share
        short = (F.col(f"__c{i}") == 0) & (F.col("__n") >= 3)
        x = x.withColumn("__c0", F.col("__c0") - short.cast("int")).withColumn(f"__c{i}", F.col(f"__c{i}") + short.cast("int"))
    name = F.when(F.col("__r") <= F.col("__c0"), "train").when(F.col("__r") <= F.col("__c0") + F.col("__c1"), "dev").otherwise("test")
    return x.withColumn("split", name).drop("__r", "__n", "__c0", "__c1", "__c2")


def round_robin_sample(df: DataFrame, n: int, by: str, source: str, seed: str = "rr", key: str = "index") -> DataFrame:
    """n rows of each value of ``by``, taken from its sources in turn. No source gives more than n, so the rest leaves before the turns."""
    inner = digest_places(df, [by, source], seed, key, "__i", "__m").filter(F.col("__i") <= n)
    return inner.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("__i", source))).filter(F.col("__r") <= n).drop("__i", "__r", "__m")


def full_sample(df: DataFrame, n: int, by: str, source: str, seed: str = "rr", key: str = "index") -> DataFrame:
    """As ``round_robin_sample``; a value of ``by`` with fewer than n rows is an error."""
    short = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < n).head(1)
    if short:
        raise ValueError(f"{short[0][0]} has {short[0]['n']} rows of {n}")
    return round_robin_sample(df, n, by, source, seed, key)


def shard(df: DataFrame, n: int, strata: list[str], seed: str = "shard", key: str = "index") -> DataFrame:
    """Rows of each stratum dealt in turn to n shards, by digest."""
    return digest_places(df, strata, seed, key).withColumn("shard", (F.col("__r") - 1) % n).drop("__r", "__n")


def limit_per(df: DataFrame, n: int, by: list[str], seed: str = "limit", key: str = "index") -> DataFrame:
    """The first n rows of each group by digest."""
    return digest_places(df, by, seed, key).filter(F.col("__r") <= n).drop("__r", "__n")


def half_split(df: DataFrame, cells: list[str], seed: str = "half", key: str = "index") -> DataFrame:
    """Every cell in two halves; the odd row goes to the second."""
    return digest_places(df, cells, seed, key).withColumn("half", F.when(F.col("__r") <= F.floor(F.col("__n") / 2), 1).otherwise(2)).drop("__r", "__n")


def uncertain_fraction(df: DataFrame, fraction: float, middle: float, strata: list[str], seed: str = "u", key: str = "index") -> DataFrame:
    """The share of each stratum closest to the middle score, ties by digest."""
    placed = value_places(df, strata, F.abs(F.col("score") - middle), [stable_digest(seed, key)])
    return placed.filter(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * fraction + 0.5))).drop("__r", "__n")


def group_folds(df: DataFrame, group: str, folds: int = 5, seed: str = "fold") -> DataFrame:
    """Whole groups in hash folds."""
    return df.withColumn("fold", F.conv(F.substring(stable_digest(seed, group), 1, 13), 16, 10).cast("long") % folds)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order; keys meet as a 256-bit digest, and the least row is found by a partial aggregate, so a hot key is no task of its own."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(k).alias(str(i)) for i, k in enumerate(keys)])), 256)
    rest = [c for c in df.columns if c not in order]
    first = df.groupBy(digest.alias("__k")).agg(F.min(F.struct(*order, *rest)).alias("__f"))
    return first.select(*[F.col("__f")[c].alias(c) for c in df.columns])


def group_split(df: DataFrame, group: str, held_out: float, seed: str = "group") -> DataFrame:
    """``side`` test for a fraction of whole groups by digest, else train; ``novel`` tells whether a test row's group is in no train row (always so)."""
    side = F.when(F.conv(F.substring(stable_digest(seed, group), 1, 13), 16, 10).cast("double") / 2.0**52 < held_out, "test").otherwise("train")
    return df.withColumn("side", side)


def mark_seen(test: DataFrame, train: DataFrame, group: str) -> DataFrame:
    """``seen`` or ``novel``: whether a held-out row's group also has rows to fit."""
    groups = train.select(group).distinct().withColumn("__seen", F.lit(True))
    return test.join(groups, group, "left").withColumn("kind", F.when(F.col("__seen"), "seen").otherwise("novel")).drop("__seen")
