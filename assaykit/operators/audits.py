"""Checks of caches and manifests, soft targets, reuse of results, facts in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import stable_fraction
from ..functions.text import sigmoid


def audit_cache(df: DataFrame, key: str, label: str, text: str, leak: str) -> DataFrame:
    """One row: rows, repeated keys, labels outside 0 and 1, empty texts, leaks, imbalance, verdict."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("bad"), F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("empty"), F.count_if(F.col(text).rlike(leak)).alias("leaks"), F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros"))
    g = per_key.agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"), F.sum("bad").alias("bad_labels"), F.sum("empty").alias("empty"), F.sum("leaks").alias("leaks"), F.abs(F.sum("ones") - F.sum("zeros")).alias("imbalance"))
    return g.withColumn("passed", (F.col("repeated") + F.col("bad_labels") + F.col("empty") + F.col("leaks")) == 0)


def write_manifest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Content hash per key."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    return df.select(key, F.sha2(F.concat_ws("\x1f", *parts), 256).alias("hash"))


def verify_manifest(df: DataFrame, manifest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that changed, went missing or are new."""
    now = write_manifest(df, key, columns).withColumnRenamed("hash", "now")
    kind = F.when(F.col("now").isNull(), "missing").when(F.col("hash").isNull(), "new").when(F.col("now") != F.col("hash"), "changed")
    return now.join(manifest, key, "full").select(key, kind.alias("kind")).filter("kind IS NOT NULL")


def soft_targets(df: DataFrame, by: str, logit: str) -> DataFrame:
    """Sigmoid of the z-score (population deviation) of a logit within its group; 0.5 where it does not vary."""
    g = df.groupBy(by).agg(F.avg(logit).alias("__m"), F.stddev_pop(logit).alias("__s"))
    z = F.when(F.col("__s") > 0, (F.col(logit) - F.col("__m")) / F.col("__s")).otherwise(0.0)
    return df.join(g, by).withColumn("target", sigmoid(z)).drop("__m", "__s")


def hash_dropout(df: DataFrame, column: str, share: float, key: str, seed: str = "drop") -> DataFrame:
    """The column is NULL for a share of the rows that their key decides."""
    return df.withColumn(column, F.when(stable_fraction(seed, key) >= share, F.col(column)))


def reuse_or_compute(
    work: DataFrame, cache: DataFrame, key: str, content: list[str], value: str, compute: Column, parsed: str | None = None, evidence: str | None = None, empty: DataFrame | None = None
) -> DataFrame:
    """Cached values whose content hash agrees (``reused`` 1), computed ones for the rest (0).

    With a ``parsed`` column of the cache only entries where it is 1 are used. With an ``evidence`` column, rows whose evidence is NULL or blank
    take the value of the empty condition, ``empty (key, value)``, if that has one (``reused`` 2), before the cache is asked.
    """
    hashed = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in content]), 256)
    usable = cache if parsed is None else cache.filter(F.col(parsed) == 1)
    rows = work.join(usable.select(key, F.col("hash").alias("__h"), F.col(value).alias("__v")), key, "left")
    hit = F.col("__h").eqNullSafe(hashed) & F.col("__v").isNotNull()
    reused, found = hit.cast("int"), F.when(hit, F.col("__v")).otherwise(compute)
    if evidence is not None and empty is not None:
        rows = rows.join(empty.select(key, F.col(value).alias("__e")), key, "left")
        inactive = (F.trim(F.coalesce(evidence, F.lit(""))) == "") & F.col("__e").isNotNull()
        reused, found = F.when(inactive, 2).otherwise(reused), F.when(inactive, F.col("__e")).otherwise(found)
    return rows.select(*work.columns, reused.alias("reused"), found.alias(value))


def merge_channels(channels: list[DataFrame], by: str, key: str) -> DataFrame:
    """Union of ranked candidate lists: best rank and number of channels of each candidate."""
    every = channels[0].select(by, key, "rank")
    for c in channels[1:]:
        every = every.unionByName(c.select(by, key, "rank"))
    return every.groupBy(by, key).agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("channels"))


def keys_except(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the first table that the second lacks; null is a key."""
    return a.select(key).subtract(b.select(key))


def popularity(events: DataFrame, by: str, value: str, special: str) -> DataFrame:
    """Rows and total per name; names that match ``special``, and null names, are left out. ``knowledge.popular_pages`` ranks and maps to pages."""
    return events.filter(~F.col(by).rlike(special)).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
