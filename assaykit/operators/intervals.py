"""Joins of intervals and points by dyadic cover.

The numbers 0 to 2**levels - 1 are the leaves of a binary tree. An interval is the disjoint union of at most two nodes a level; a
point lies in one node of each level. So a point and an interval that holds it meet in exactly one node, an equi-join, and
every row that the join makes is a result: long intervals, hot keys and open ends make no pairs that a filter has to drop. Two
intervals overlap if one's start lies in the other, so a pair of them meets once as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrowtext import cut


def months(text: Column, end: bool = False) -> Column:
    """Months since year 0 of ``YYYY`` or ``YYYY-MM``; a year alone begins in January and ends in December. Other texts are NULL."""
    year, month = (F.regexp_extract(text.cast("string"), r"^(\d{1,4})(?:-(0[1-9]|1[0-2]))?$", i) for i in (1, 2))
    rest = F.when(month != "", month.cast("int") - 1).otherwise(11 if end else 0)
    return F.when(year != "", year.cast("int") * 12 + rest)


def _node(level: int, node: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), node.cast("long").alias("node"))


def _nodes(levels: int, start: Column, end: Column) -> Column:
    """The cover of [start, end] as (level, node) pairs; none where start > end."""
    out = []
    for i in range(levels + 1):
        a, b = F.ceil(start / 2**i).cast("long"), F.floor((end + 1) / 2**i).cast("long")
        out += [F.when((a < b) & (a % 2 == 1), _node(i, a)), F.when((a < b) & (b % 2 == 1), _node(i, b - 1))]
    return F.array_compact(F.array(*out))


def _ancestors(levels: int, point: Column) -> Column:
    return F.array(*[_node(i, F.floor(point / 2**i)) for i in range(levels + 1)])


def _bounds(sides: list[tuple[DataFrame, list[str]]]) -> tuple[int, int]:
    every = None
    for df, columns in sides:
        one = df.select(F.explode(F.array(*[F.col(c).cast("long") for c in columns])).alias("y"))
        every = one if every is None else every.unionByName(one)
    low, high = every.agg(F.min("y"), F.max("y")).first()
    return low or 0, high or 0


def _meet(points: DataFrame, point: str, intervals: DataFrame, start: Column, end: Column, on: list[str], low: int, levels: int) -> DataFrame:
    p = points.withColumn("__n", F.explode(_ancestors(levels, F.col(point).cast("long") - low)))
    i = intervals.withColumn("__n", F.explode(_nodes(levels, start.cast("long") - low, end.cast("long") - low)))
    # Nodes are many times the rows that Spark's estimate knows of, so neither side may be broadcast.
    return p.join(i.hint("merge"), [*on, "__n"]).drop("__n")


def holding(points: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, end: str, slack: int = 0) -> DataFrame:
    """Each point beside the intervals of its key that hold it, widened by ``slack`` on both sides; null bounds are open.

    Rows without a point, and intervals whose start lies behind their end, meet nothing. Columns but ``on`` must differ.
    """
    low, high = _bounds([(points, [point]), (intervals, [start, end])])
    low, levels = low - slack, max(1, int(high + slack - low + slack).bit_length())
    inside = (F.greatest(F.lit(low), F.coalesce(F.col(start).cast("long") - slack, F.lit(low))), F.coalesce(F.col(end).cast("long") + slack, F.lit(high + slack)))
    right = intervals.filter(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) <= F.col(end)))
    return _meet(points.filter(F.col(point).isNotNull()), point, right, *inside, on, low, levels)


def overlapping(left: DataFrame, right: DataFrame, on: list[str], start: str, end: str, other_start: str, other_end: str) -> DataFrame:
    """Each pair of intervals of one key that share a number, once; null bounds are open. Columns but ``on`` must differ."""
    low, high = _bounds([(left, [start, end]), (right, [other_start, other_end])])
    levels = max(1, int(high - low + 1).bit_length())

    def closed(df: DataFrame, a: str, b: str, x: str, y: str) -> DataFrame:
        both = df.withColumn(x, F.coalesce(F.col(a).cast("long"), F.lit(low))).withColumn(y, F.coalesce(F.col(b).cast("long"), F.lit(high)))
        return both.filter(F.col(x) <= F.col(y))

    one, two = closed(left, start, end, "__a", "__b"), closed(right, other_start, other_end, "__c", "__d")
    later = _meet(two, "__c", one, F.col("__a"), F.col("__b"), on, low, levels)
    earlier = _meet(one, "__a", two, F.col("__c") + 1, F.col("__d"), on, low, levels)
    return later.unionByName(earlier).drop("__a", "__b", "__c", "__d")


def facts_for_claims(claims: DataFrame, facts: DataFrame, on: list[str], year: str = "year", start: str = "start", end: str = "end", slack: int = 0) -> DataFrame:
    """Facts of a claim whose interval, open at a null end and widened by ``slack`` years, holds its year; a claim without a year takes all."""
    dated = holding(claims, facts, on, year, start, end, slack)
    return dated.unionByName(claims.filter(F.col(year).isNull()).join(facts, on))


def facts_at(facts: DataFrame, claims: DataFrame, start: str, end: str, year: str) -> DataFrame:
    """Facts whose closed interval of years holds a claim's year; null bounds are open."""
    return holding(claims, facts, [], year, start, end)


def concurrent_holders(facts: DataFrame, held: str | None = None, other: str | None = None) -> DataFrame:
    """Pairs of holders of two offices of one jurisdiction at overlapping times: ``person, office, other, other_office``, one row for each
    pair of facts.

    ``facts (person, office, jurisdiction, start, end)`` and, if words are asked for, ``role``: the first side's role matches the
    pattern ``held``, the second side's ``other``, both in any case. Bounds are numbers (years, or ``months``); null ones are open.
    """
    word = lambda pattern: F.lower("role").rlike(pattern) if pattern else F.lit(True)
    columns = ["person", "office", "jurisdiction", "start", "end"]
    left = facts.filter(word(held)).select(columns)
    right = facts.filter(word(other)).select(columns).withColumnsRenamed({"person": "other", "office": "other_office", "start": "other_start", "end": "other_end"})
    met = overlapping(left, right, ["jurisdiction"], "start", "end", "other_start", "other_end")
    return met.filter((F.col("person") != F.col("other")) & (F.col("office") != F.col("other_office")))


def overlapping_holders(facts: DataFrame) -> DataFrame:
    """``person, other``: people whose offices belong to one jurisdiction at overlapping times; null ends are open.

    People with the same set of facts are one class. Only pairs of classes are joined and made distinct; those that meet are
    then written out as pairs of people, which no task has to hold.
    """
    own = facts.filter("person IS NOT NULL").groupBy("person").agg(F.sort_array(F.collect_set(F.struct("office", "jurisdiction", "start", "end"))).alias("facts"))
    people = cut(own.withColumn("class", F.md5(F.to_json("facts"))))
    kinds = people.groupBy("class").agg(F.first("facts").alias("facts")).select("class", F.explode("facts").alias("f")).select("class", "f.*")
    others = kinds.withColumnsRenamed({"class": "other", "office": "other_office", "start": "other_start", "end": "other_end"})
    met = overlapping(kinds, others, ["jurisdiction"], "start", "end", "other_start", "other_end").filter(F.col("office") != F.col("other_office"))
    pairs = cut(met.select("class", F.col("other").alias("other_class")).distinct())
    first = pairs.join(people.select("class", "person").hint("merge"), "class")
    both = first.join(people.select(F.col("class").alias("other_class"), F.col("person").alias("other")).hint("merge"), "other_class")
    return both.filter(F.col("person") != F.col("other")).select("person", "other")
