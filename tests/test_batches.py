"""Greedy batches against the greedy pass over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import batches
from assaykit.operators.batches import Limits


def plain(rows, limits):
    order, out, current, total = sorted(rows, key=lambda r: (r[1], r[0])), {}, 0, 0
    number = -1
    for key, length in order:
        tier = next((n for upto, n in limits.tiers if upto is None or length <= upto), limits.rows)
        grows = current and current < min(limits.rows, tier)
        grows = grows and (limits.padded is None or (current + 1) * length <= limits.padded)
        grows = grows and (limits.flat is None or total + length <= limits.flat)
        if not grows:
            number, current, total = number + 1, 0, 0
        current, total = current + 1, total + length
        out[key] = number
    return out


CASES = [Limits(48, padded=20_000), Limits(5), Limits(64, flat=3_000), Limits(48, tiers=batches.TIERS), Limits(7, padded=900, flat=700), Limits(1)]


@pytest.mark.parametrize("limits", CASES)
def test_batches_are_the_greedy_ones(spark, limits):
    rng = np.random.default_rng(len(str(limits)))
    rows = [(i, int(x)) for i, x in enumerate(np.concatenate([rng.integers(0, 1200, 700), np.full(300, 50), [30_000, 30_000]]))]
    df = spark.createDataFrame(rows + [(5000, None)], "id long, n int")
    got = batches.budget_batches(df, "id", "n", limits)
    assert {r["id"]: r["batch"] for r in got.collect()} == plain(rows, limits)
    report = batches.padding_report(got, "n").first()
    assert report["batches"] == max(plain(rows, limits).values()) + 1 and report["padding"] == got.groupBy("batch").agg((F.count("n") * F.max("n") - F.sum("n")).alias("x")).agg(F.sum("x")).first()[0]


def test_few_lengths_many_rows():
    runs = batches.segments([10, 20, 1000], [10**12, 10**9 + 1, 3], Limits(48, padded=1500))
    assert len(runs) <= 6 and sum(s * n for _, s, n in runs) == 10**12 + 10**9 + 4


def test_no_rows_and_too_many_lengths(spark, monkeypatch):
    df = spark.createDataFrame([], "id long, n int")
    assert batches.budget_batches(df, "id", "n", Limits(4)).collect() == []
    monkeypatch.setattr(batches, "MOST_LENGTHS", 2)
    with pytest.raises(ValueError):
        batches.budget_batches(spark.createDataFrame([(i, i) for i in range(4)], "id long, n int"), "id", "n", Limits(4))
