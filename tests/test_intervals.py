"""Interval joins against all pairs, with long intervals, open ends and one hot key."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import intervals

SCHEMA = "k string, i long, a long, b long"


def rows(seed, n=150):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a = int(rng.integers(1500, 2000))
        b = a + int(rng.choice([0, 1, 5, 200]))
        out.append(("hot" if rng.random() < 0.7 else f"k{i % 5}", i, None if rng.random() < 0.1 else a, None if rng.random() < 0.1 else b))
    return out + [("hot", n, 1900, 1850), ("hot", n + 1, None, None), (None, n + 2, 1900, 1950)]


def overlap(x, y):
    if any(a is not None and b is not None and a > b for a, b in (x[2:], y[2:])):
        return False
    return (x[3] is None or y[2] is None or y[2] <= x[3]) and (y[3] is None or x[2] is None or x[2] <= y[3])


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_meet_once(spark, seed):
    left, right = rows(seed), rows(seed + 10)
    got = intervals.overlapping(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).toDF("k", "j", "c", "d"), ["k"], "a", "b", "c", "d")
    want = collections.Counter((x[1], y[1]) for x in left for y in right if x[0] is not None and x[0] == y[0] and overlap(x, y))
    assert collections.Counter((r["i"], r["j"]) for r in got.collect()) == want
    assert sorted(got.columns) == ["a", "b", "c", "d", "i", "j", "k"]


@pytest.mark.parametrize("slack", [0, 1])
def test_points_meet_their_intervals(spark, slack):
    facts = rows(3)
    claims = [("hot", c, 1500 + c) for c in range(0, 500, 7)] + [("k1", 900, None), ("k2", 901, 1700), (None, 902, 1900), ("hot", 903, 3000)]
    got = intervals.facts_for_claims(spark.createDataFrame(claims, "k string, c long, year long"), spark.createDataFrame(facts, SCHEMA), ["k"], "year", "a", "b", slack)
    inside = lambda y, a, b: y is None or ((a is None or b is None or a <= b) and (a is None or a - slack <= y) and (b is None or y <= b + slack))
    want = collections.Counter((c[1], f[1]) for c in claims for f in facts if c[0] is not None and c[0] == f[0] and inside(c[2], f[2], f[3]))
    assert collections.Counter((r["c"], r["i"]) for r in got.collect()) == want


def test_no_join_makes_more_than_the_result(spark):
    """200-year intervals of one jurisdiction: the rows of the join are the pairs that overlap."""
    people = [(f"p{i}", f"o{i % 2}", "hot", 1500 + i, 1700 + i, ["King", "prime minister"][i % 2]) for i in range(200)]
    facts = spark.createDataFrame(people, "person string, office string, jurisdiction string, start int, end int, role string")
    got = intervals.concurrent_holders(facts, "prime minister|premier", "monarch|king").select("person", "other")
    want = {(a[0], b[0]) for a in people for b in people if a[5] == "prime minister" and b[5] == "King" and a[3] <= b[4] and b[3] <= a[4]}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    every = intervals.overlapping_holders(facts)
    assert every.count() == sum(1 for a in people for b in people if a[0] != b[0] and a[1] != b[1] and a[3] <= b[4] and b[3] <= a[4])


def test_months(spark):
    t = spark.createDataFrame([("1999",), ("1999-03",), ("x",), (None,), ("1999-13",)], "t string")
    got = t.select(intervals.months(F.col("t")).alias("a"), intervals.months(F.col("t"), True).alias("b")).collect()
    assert [tuple(r) for r in got] == [(23988, 23999), (23990, 23990), (None, None), (None, None), (None, None)]


def test_empty_sides(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert intervals.overlapping(e, e.toDF("k", "j", "c", "d"), ["k"], "a", "b", "c", "d").collect() == []
    assert intervals.facts_for_claims(e.select("k", F.col("i").alias("year")), e, ["k"], "year", "a", "b").collect() == []


def test_intervals_are_not_broadcast_and_pairs_of_people_not_gathered(spark):
    """An exploded side was broadcast through the driver; all pairs of people were made distinct."""
    facts = spark.createDataFrame([(i, i % 3, 0, 1900 + i % 4, None if i % 7 == 0 else 1901 + i % 4) for i in range(240)] + [(0, 1, 0, 1800, 1801), (None, 1, 0, 1900, 1901)], "person long, office int, jurisdiction int, start int, end int")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(intervals.concurrent_holders(facts))
    got = intervals.overlapping_holders(facts)
    assert "Aggregate" not in plan(got)
    found = [tuple(r) for r in got.collect()]
    want = {(r["person"], r["other"]) for r in intervals.concurrent_holders(facts).select("person", "other").collect()}
    assert len(found) == len(set(found)) and set(found) == want and want
