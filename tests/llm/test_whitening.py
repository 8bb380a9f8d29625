"""Whitening against numpy's own eigenvectors, exact sums against whole numbers, and odd rows."""

import math
import tempfile

import numpy as np
import pytest

from assaykit.llm import queries
from assaykit.llm.whitening import components, polar_factor, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, "x") for i, v in rows], SCHEMA)


def plain(rows, k):
    """Exact deviations, whitened values up to sign and explained shares, by numpy and whole numbers."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in kept)
    x = np.array([v + [1_000_000] * (width - len(v)) for _, v in kept], np.int64)
    n, s = len(x), x.sum(0)
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    z = x - s / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return [i for i, _ in kept], deviation, z @ v / np.sqrt(e), e / np.trace(z.T @ z / n)


@pytest.mark.parametrize("n,width", [(300, 40), (60, 3), (5000, 16)])
def test_against_numpy(spark, n, width):
    rng = np.random.default_rng(n)
    data = (rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * 0.3).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(data.tolist())]
    rows += [(n, None), (n + 1, [0.1] * (width - 1) + [None]), (n + 2, [float("nan")] * width), (n + 3, [math.inf] * width), (7, data[7].tolist()), (None, data[3].tolist()), (n + 4, [0.25])]
    got = whiten(table(spark, rows)).collect()
    ids, deviation, white, share = plain(rows, 32)
    k = min(32, width)
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {len(ids)}
    assert {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-6
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-9
    key = lambda i: -1 if i is None else i
    for c, mine in by.items():
        mine.sort(key=lambda r: (key(r["vec_id"]), r["deviation"]))
        order = sorted(range(len(ids)), key=lambda j: (key(ids[j]), deviation[j]))
        assert [r["deviation"] for r in mine] == [deviation[j] for j in order]
        w, mine_w = white[order, c - 1], np.array([r["whitened"] for r in mine])
        assert np.allclose(mine_w, w * np.sign(w @ mine_w), atol=1e-7)


def test_splitting_finds_equal_and_close_eigenvalues():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    for values in ([5.0] * 10 + [1.0] * 20, np.linspace(1, 1 + 1e-6, 30), 10.0 ** -np.arange(30), [0.0] * 29 + [2.0], [3.0] * 30, [0.0] * 30):
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        e, v = components(a)
        assert np.allclose(e, np.sort(values)[::-1], atol=1e-13 * max(1, np.max(values))) and np.allclose(v.T @ v, np.eye(30), atol=1e-12)
        assert np.allclose(v @ np.diag(e) @ v.T, a, atol=1e-12 * max(1, np.max(values)))


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(1).normal(size=(20, 20))
    a = a + a.T
    u = polar_factor(a)
    h = u.T @ a
    assert np.allclose(u @ u, np.eye(20), atol=1e-12) and np.allclose(h, h.T, atol=1e-11) and np.linalg.eigvalsh(h).min() > 0


def test_vectors_without_variance_and_empty_tables(spark):
    assert whiten(table(spark, [])).collect() == [] and whiten(table(spark, [(1, None)])).collect() == []
    one = whiten(table(spark, [(1, [0.5, 2.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    rows = whiten(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()  # the second entry is constant
    assert sorted((r["vec_id"], r["component"], r["deviation"], r["whitened"] is None) for r in rows) == [(1, 1, 4096, False), (1, 2, 4096, True), (2, 1, 4096, False), (2, 2, 4096, True)]


def test_query_over_the_table(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    data = np.random.default_rng(5).normal(size=(200, 48)).astype(np.float32).tolist()
    table(spark, list(enumerate(data))).write.parquet(f"{path}/embeddings.parquet")
    got = queries.queries()["op11_qdwh_whitening"](spark, path)
    assert got.count() == 200 * 32 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
