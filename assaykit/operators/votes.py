"""Ensembles in long form (``index, member, decision``): votes, disagreement, cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote(members: DataFrame, size: int) -> DataFrame:
    """OR, majority, unanimous and mean of complete ensembles; incomplete ones are left out."""
    g = members.groupBy("index").agg(F.count(F.lit(1)).alias("n"), F.sum("decision").alias("yes"), F.first("label").alias("label")).filter(F.col("n") == size)
    return g.select("index", "label", (F.col("yes") > 0).cast("int").alias("any"), (F.col("yes") * 2 > size).cast("int").alias("majority"), (F.col("yes") == size).cast("int").alias("unanimous"), (F.col("yes") / size).alias("mean"))


def disagreement(members: DataFrame) -> DataFrame:
    """Rows on which each pair of members differs; one shuffle of the votes as a map per row."""
    votes = members.groupBy("index").agg(F.sort_array(F.collect_list(F.struct("member", "decision"))).alias("v"))
    pairs = votes.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b")).filter("a.member < b.member")
    return pairs.groupBy(F.col("a.member").alias("first"), F.col("b.member").alias("second")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a.decision") != F.col("b.decision")).alias("differ"))


def cascade_cost(members: DataFrame) -> DataFrame:
    """Stops of each member asked in order until the first positive, and evaluations up to there."""
    w = Window.partitionBy("index")
    stop = F.coalesce(F.min(F.when(F.col("decision") == 1, F.col("member"))).over(w), F.max("member").over(w))
    return members.withColumn("stop", stop).filter(F.col("member") <= F.col("stop")).groupBy("member").agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("member") == F.col("stop")).alias("stopped"))


def escalate(members: DataFrame, cheap: list[int], expensive: int) -> DataFrame:
    """The expensive member's decision where cheap ones differ, theirs otherwise."""
    is_cheap = F.col("member").isin(cheap)
    low, high = F.min(F.when(is_cheap, F.col("decision"))), F.max(F.when(is_cheap, F.col("decision")))
    g = members.groupBy("index").agg(low.alias("low"), high.alias("high"), F.max(F.when(F.col("member") == expensive, F.col("decision"))).alias("top"))
    queried = F.col("low") != F.col("high")
    return g.select("index", queried.cast("int").alias("queried"), F.when(queried, F.col("top")).otherwise(F.col("low")).alias("decision"))


def pivot_members(members: DataFrame, names: list[int], prefix: str = "m") -> DataFrame:
    """One row per index, one column per named member."""
    return members.groupBy("index").agg(*[F.max(F.when(F.col("member") == m, F.col("decision"))).alias(f"{prefix}{m}") for m in names])
