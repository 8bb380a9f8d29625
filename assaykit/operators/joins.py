"""Joins on row identity with their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import value_places


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str], check: tuple[str, ...] = ("label",)) -> DataFrame:
    """Inner join that fails on duplicate keys, lost rows, or labels that disagree (decided by aggregates)."""
    shared = [c for c in check if c in left.columns and c in right.columns]
    side = lambda d, n: d.select(*on, F.lit(n).alias("__side"), *shared)
    of = lambda n: F.count_if(F.col("__side") == n)
    differ = F.lit(False)
    for c in shared:
        value = F.struct(F.col(c).isNull().alias("null"), F.col(c).alias("value"))
        differ = differ | (F.min(value) != F.max(value))
    # One aggregate over the keys of both sides decides all three.
    keys = side(left, 0).unionByName(side(right, 1)).groupBy(*on).agg(of(0).alias("a"), of(1).alias("b"), differ.alias("differ"))
    seen = keys.agg(F.count_if(F.expr("a > 1 OR b > 1")).alias("twice"), F.count_if(F.expr("a = 0 OR b = 0")).alias("lost"), F.count_if("differ").alias("differ")).first()
    for name, message in (("twice", "duplicate keys"), ("lost", "rows were lost"), ("differ", "labels disagree")):
        if seen[name]:
            raise ValueError(message)
    return left.join(right.drop(*shared), on)


def select_manifest(df: DataFrame, manifest: DataFrame, on: list[str]) -> DataFrame:
    """Exactly the rows whose keys the manifest lists; ``relations.manifest_report`` tells which it lacks or labels otherwise."""
    return df.join(manifest.select(*on).distinct(), on, "left_semi")


def exclude_used(df: DataFrame, used: list[DataFrame], on: str) -> DataFrame:
    """Rows whose id no earlier table used."""
    ids = used[0].select(on)
    for u in used[1:]:
        ids = ids.unionByName(u.select(on))
    return df.join(ids.distinct(), on, "left_anti")


def common_keys(tables: list[DataFrame], key: str, label: str) -> DataFrame:
    """Keys present in every table with one agreed label."""
    tagged = [t.select(key, label, F.lit(i).alias("src")) for i, t in enumerate(tables)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    g = every.groupBy(key).agg(F.count_distinct("src").alias("s"), F.min(label).alias(label), F.max(label).alias("m"))
    return g.filter((F.col("s") == len(tables)) & (F.col(label) == F.col("m"))).select(key, label)


def coverage_diff(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """How many keys are new, lost or in both."""
    a, b = new.select(key).distinct().withColumn("a", F.lit(1)), old.select(key).distinct().withColumn("b", F.lit(1))
    kind = F.when(F.col("a").isNull(), "lost").when(F.col("b").isNull(), "new").otherwise("both")
    return a.join(b, key, "full").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def prefer_decisive(stages: DataFrame, key: str) -> DataFrame:
    """The first decisive stage's answer, or the first stage's where none is."""
    return stages.groupBy(key).agg(F.min_by(F.struct("stage", "answer"), F.struct(~F.col("decisive"), F.col("stage"))).alias("s")).select(key, "s.stage", "s.answer")


def label_null(df: DataFrame, label: str = "label", order: str = "index", value: str = "score") -> DataFrame:
    """The value shifted by one within each label, wrapping around: a null baseline."""
    placed = value_places(df, [label], F.col(order).cast("double"), [order])
    nexts = placed.select(F.col(label).alias("__l"), F.col("__r").alias("__at"), F.col(value).alias("shifted"))
    at = F.when(F.col("__r") < F.col("__n"), F.col("__r") + 1).otherwise(1)
    return placed.withColumn("__want", at).join(nexts, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__want") == F.col("__at"))).drop("__r", "__n", "__l", "__at", "__want")


def compose_routes(control: DataFrame, specialist: DataFrame, route) -> DataFrame:
    """The specialist's score where the route fires, otherwise the control's."""
    s = specialist.select("index", F.col("score").alias("__s"))
    return control.join(s, "index").withColumn("score", F.when(route, F.col("__s")).otherwise(F.col("score"))).drop("__s")


def retry_set(base: DataFrame, members: DataFrame, n: int, key: str) -> DataFrame:
    """Rows with fewer than n complete members."""
    done = members.groupBy(key).agg(F.count_if("complete").alias("c"))
    return base.join(done, key, "left").filter(F.coalesce("c", F.lit(0)) < n).select(key, F.coalesce("c", F.lit(0)).alias("complete"))
