"""Matched shuffles against a sequential scan."""

import collections

import numpy as np
import pytest

from assaykit.operators import donors


def plain(rows):
    buckets = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        buckets[r[2]].append(r)
    out = {}
    for c, own in buckets.items():
        for i, r in enumerate(own):
            out[r[1]] = next((own[(i + h) % len(own)][1] for h in range(1, len(own) + 1) if own[(i + h) % len(own)][0] != r[0]), None) if c else None
    return out


@pytest.mark.parametrize("seed,width", [(1, 65_536), (2, 7), (3, 1)])
def test_next_row_of_another_unit(spark, monkeypatch, seed, width):
    monkeypatch.setattr(donors, "RANGE", width)
    rng = np.random.default_rng(seed)
    rows = [(["a", "a", "a", "b", "c"][int(rng.integers(5))], i * 3, int(rng.integers(0, 4))) for i in range(300)]
    rows += [("b", 5000 + i, 9) for i in range(4)] + [("a", 6000, 8), ("b", 6001, 8), ("a", 6002, 8), ("a", -1, 8)]
    df = spark.createDataFrame(rows, "unit string, key long, n int")
    found = donors.next_donors(df, "unit", "key", "n")
    want = plain(rows)
    assert {r["key"]: r["donor"] for r in found.collect()} == want
    passages = [(u, k) for u, k, n in sorted(rows, key=lambda r: r[1]) for _ in range(n)]
    got = collections.defaultdict(list)
    for r in sorted(donors.fallback_passages(df, found, "unit", "key", "n").collect(), key=lambda r: r["place"]):
        got[r["key"]].append(r["donor"])
    needy = {k: (u, n) for u, k, n in rows if n and want[k] is None}
    assert got == {k: [d for v, d in passages if v != u][:n] for k, (u, n) in needy.items()} and needy


def test_rotation_with_the_fewest_repeats(spark):
    rng = np.random.default_rng(4)
    left, right = [rng.integers(0, 12, 40) for _ in range(2)]
    table = lambda xs, base: spark.createDataFrame([(i, base + i, int(x)) for i, x in enumerate(xs)], "place long, key long, idx long")
    repeats = [(int((left == np.roll(right, -s)).sum()), s) for s in range(40)]
    one, two = table(left, 0), table(right, 1000)
    assert tuple(donors.choose_rotation(one, two, "place", "idx").first()) == min(repeats)[::-1]
    got = {r["key"]: r["donor"] for r in donors.rotated(one, two, "place", "key", "idx").collect()}
    assert got == {i: 1000 + (i + min(repeats)[1]) % 40 for i in range(40)}
    with pytest.raises(ValueError):
        donors.choose_rotation(one, two.limit(3), "place", "idx")


def test_no_rows(spark):
    df = spark.createDataFrame([], "unit string, key long, n int")
    found = donors.next_donors(df, "unit", "key", "n")
    assert found.collect() == [] and donors.fallback_passages(df, found, "unit", "key", "n").collect() == []


def test_frequent_indexes_are_counted_without_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n = 301
    x, y = rng.integers(0, 3, n), rng.integers(0, 3, n)
    x[:40], y[:40] = rng.integers(100, 130, 40), rng.integers(100, 130, 40)
    one, two = (spark.createDataFrame([(p, int(v) if v else None) for p, v in enumerate(side)], "p long, x int") for side in (x, y))
    own = [sum(int(x[p] == y[(p + s) % n] != 0) for p in range(n)) for s in range(n)]
    want = (int(np.argmin(own)), min(own))
    found = []
    counted = donors._shift_counts
    monkeypatch.setattr(donors, "_shift_counts", lambda n, length: found.append(length) or counted(n, length))
    for least, block in ((0, 2**21), (16, 50), (10**9, 50)):
        monkeypatch.setattr(donors, "PAIRS_A_PLACE", least)
        monkeypatch.setattr(donors, "MOST_BLOCK", block)
        assert tuple(donors.choose_rotation(one, two, "p", "x").first()) == want
    assert len(found) == 2
