"""Connected components of a table of links, by contraction; no table of links is gathered on the driver, and none beyond ``FEW`` rows is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import cut, cut_few, met


def components(links: DataFrame, u: str = "x", v: str = "y", most: int | None = None) -> DataFrame:
    """``node, label`` for every node of a link; the label is the smallest node of its component.

    Each round points every node at its smallest neighbour, follows the pointers twice and contracts the links;
    the rounds are logarithmic in the longest path. A hub is pre-aggregated, and joins on it can be split. ``most`` bounds the
    number of links, if that is known; rounds of few links take few tasks.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    edges = links.select(F.explode(F.array(F.struct(a.alias("a"), b.alias("b")), F.struct(b.alias("a"), a.alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
    edges = cut(edges) if most is None else cut_few(edges, 2 * most)
    labels, nodes = None, 0
    while n := edges.count():
        to = cut_few(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), n)
        for _ in range(2):
            to = to.join(met(to.select(F.col("node").alias("to"), F.col("to").alias("next")), n), "to").select("node", F.col("next").alias("to"))
        to = cut_few(to, n)
        nodes = nodes or n  # nodes of later rounds are nodes of the first, which has at most as many as links
        labels = to.withColumnRenamed("to", "label") if labels is None else labels.join(met(to.withColumnRenamed("node", "label"), n), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        moved = edges.join(met(to.select(F.col("node").alias("a"), F.col("to").alias("p")), n), "a").join(met(to.select(F.col("node").alias("b"), F.col("to").alias("q")), n), "b")
        edges = cut_few(moved.filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), n)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return cut_few(labels, nodes)
