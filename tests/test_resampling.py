"""Bootstraps against NumPy's own resampling of rows."""

import math

import numpy as np
import pyarrow as pa
import pytest

from assaykit.operators import resampling


def fixture(spark):
    rng = np.random.default_rng(11)
    rows = []
    for unit, n in (("a", 160), ("b", 90)):
        label = (rng.random(n) < 0.4).astype(int)
        x = np.round(rng.normal(size=n) + label, 1)
        y = np.round(x + rng.normal(size=n) * 0.7 + 0.3 * label, 1)
        rows += [(unit, i, int(l), float(a), float(b), int(a > 0.5), int(b > 0.5)) for i, (l, a, b) in enumerate(zip(label, x, y, strict=True))]
    rows += [("one", 0, 1, 0.5, 0.5, 1, 0), ("a", 1000, None, 0.1, 0.2, 0, 1), ("a", 1001, 1, None, 0.3, None, None)]
    return rows, spark.createDataFrame(rows, "unit string, index long, label int, x double, y double, d int, e int")


def auroc(pos, neg):
    return ((pos[:, :, None] > neg[:, None, :]) + 0.5 * (pos[:, :, None] == neg[:, None, :])).mean((1, 2))


def test_auroc_intervals(spark):
    rows, df = fixture(spark)
    got = {r["unit"]: r for r in resampling.bootstrap_auroc(df, "unit", "index", "x", "y", 5000).collect()}
    rng, means = np.random.default_rng(0), []
    for unit in "ab":
        own = np.array([r[2:5] for r in rows if r[0] == unit and r[2] is not None and r[3] is not None])
        pos, neg = own[own[:, 0] == 1], own[own[:, 0] == 0]
        deltas = []
        for _ in range(20):
            p, n = (part[rng.integers(0, len(part), (250, len(part)))] for part in (pos, neg))
            deltas.append(auroc(p[:, :, 2], n[:, :, 2]) - auroc(p[:, :, 1], n[:, :, 1]))
        deltas = np.concatenate(deltas)
        means.append(deltas)
        assert got[unit]["samples"] == 5000 and abs(got[unit]["mean"] - deltas.mean()) < 0.002
        assert abs(got[unit]["low"] - np.quantile(deltas, 0.025)) < 0.006 and abs(got[unit]["high"] - np.quantile(deltas, 0.975)) < 0.006
    macro = np.mean(means, 0)
    assert abs(got[None]["low"] - np.quantile(macro, 0.025)) < 0.005 and "one" not in got


def test_balanced_accuracy_intervals(spark):
    rows, df = fixture(spark)
    got = {r["unit"]: r for r in resampling.bootstrap_ba(df, "unit", 5000, a="d", b="e").collect()}
    rng = np.random.default_rng(1)
    for unit in "ab":
        own = [r for r in rows if r[0] == unit and r[2] is not None]
        change = lambda y: np.array([(r[6] or 0) - (r[5] or 0) for r in own if r[2] == y])  # noqa: E731, B023
        pos, neg = (c[rng.integers(0, len(c), (200_000 // 10, len(c)))].mean(1) for c in (change(1), change(0)))
        deltas = (pos - neg) / 2
        assert abs(got[unit]["mean"] - deltas.mean()) < 0.002
        assert abs(got[unit]["low"] - np.quantile(deltas, 0.025)) < 0.005 and abs(got[unit]["high"] - np.quantile(deltas, 0.975)) < 0.005
    assert "one" not in got


@pytest.mark.parametrize("n,p", [(1, 0.5), (40, 0.03), (1000, 0.4), (10**9, 0.25), (50, 1.0), (50, 0.0), (0, 0.3)])
def test_binomial_tables(n, p):
    low, table = resampling.binomial_table(n, p)
    if n <= 1000 and 0 < p < 1:
        want = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(low, low + len(table))])
        assert np.allclose(table, want, atol=1e-12)
    b = 10**6
    drawn = resampling.binomial_draws(np.full(999, n), np.full(999, int(p * b)), np.full(999, b), (np.arange(999) + 0.5) / 999)
    sd = math.sqrt(n * p * (1 - p))
    assert abs(drawn.mean() - n * p) <= 0.06 * sd + 1e-9 and abs(drawn.std() - sd) <= 0.06 * sd + 1e-9


def test_many_cells_take_weights(spark, monkeypatch):
    monkeypatch.setattr(resampling, "MOST_CELLS", 3)
    _, df = fixture(spark)
    got = {r["unit"]: r for r in resampling.bootstrap_auroc(df, "unit", "index", "x", "y", 40).collect()}
    assert got["a"]["samples"] == 40 and got["a"]["low"] <= got["a"]["mean"] <= got["a"]["high"]


def test_no_rows(spark):
    _, df = fixture(spark)
    assert resampling.bootstrap_ba(df.limit(0), "unit", 10, a="d", b="e").collect() == []
    assert resampling.bootstrap_auroc(df.limit(0), "unit", "index", "x", "y", 10).collect() == []


def test_samples_of_many_cells_are_drawn_a_few_at_a_time(monkeypatch):
    """125 samples of a million cells took over 4 GB of a worker."""
    rng = np.random.default_rng(3)
    cells = [{"l": int(i % 2), "x": float(a), "y": float(b), "c": int(c)} for i, (a, b, c) in enumerate(zip(rng.random(40), rng.random(40), rng.integers(1, 5, 40), strict=True))]
    kinds = pa.list_(pa.struct([("l", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("c", pa.int64())]))
    batch = pa.RecordBatch.from_pylist([{"unit": "u", "cells": cells, "seed": 5, "first": 1, "samples": 25}], pa.schema([("unit", pa.string()), ("cells", kinds), ("seed", pa.int64()), ("first", pa.int32()), ("samples", pa.int32())]))
    whole = pa.Table.from_batches(resampling._auroc_samples([batch]))
    drawn, drew = [], resampling.draw_counts
    monkeypatch.setattr(resampling, "draw_counts", lambda c, s, numbers: drawn.append(len(c) * len(numbers)) or drew(c, s, numbers))
    monkeypatch.setattr(resampling, "DRAWN_AT_ONCE", 100)
    assert pa.Table.from_batches(resampling._auroc_samples([batch])).to_pydict() == whole.to_pydict()
    assert max(drawn) <= 100
