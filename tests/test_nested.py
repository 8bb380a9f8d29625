"""Models fitted together against models fitted one by one."""

import numpy as np
import pytest

from assaykit.operators import nested


def newton(x, y, w, c, balanced):
    mean, sd = x.mean(0), x.std(0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / sd])
    v = w * (np.array([w.sum() / (2 * w[y == k].sum()) for k in (0, 1)])[y.astype(int)] if balanced else 1)
    beta, ridge = np.zeros(z.shape[1]), np.r_[0, np.full(x.shape[1], 1 / c)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta - np.linalg.solve((z * (v * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (v * (p - y)) + ridge * beta)
    return lambda q: 1 / (1 + np.exp(-(np.hstack([np.ones((len(q), 1)), (q - mean) / sd]) @ beta)))


def table(spark, seed=0, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 2] + [0, 3, 0, -1]
    y = (x[:, 0] + 0.4 * x[:, 3] + rng.normal(size=n) > -0.3).astype(int)
    g = rng.integers(0, 4, n)
    w = rng.random(n) + 0.5
    rows = [(i, f"g{g[i]}", *map(float, x[i]), int(y[i]), float(w[i])) for i in range(n)]
    odd = [(900, None, 1.0, 1.0, 1.0, 1.0, 1, 1.0), (901, "g1", None, 1.0, 1.0, 1.0, 1, 1.0), (902, "g1", 1.0, 1.0, 1.0, 1.0, None, 1.0), (903, "g1", float("nan"), 1.0, 1.0, 1.0, 0, 1.0)]
    return spark.createDataFrame(rows + odd, "id long, g string, a double, b double, c double, d double, y int, w double").repartition(3), x, y, g, w


@pytest.mark.parametrize("balanced", [False, True])
def test_leave_one_group_out(spark, balanced):
    df, x, y, g, w = table(spark)
    got = {r["id"]: r["oof"] for r in nested.grouped_oof(df, "id", "g", ["a", "b", "c", "d"], "y", 0.5, "w", balanced).collect()}
    assert set(got) == set(range(len(x)))
    for k in range(4):
        want = newton(x[g != k], y[g != k], w[g != k], 0.5, balanced)(x[g == k])
        assert np.allclose([got[i] for i in np.flatnonzero(g == k)], want, atol=1e-6)


def test_choice_of_c_within_each_group(spark):
    df, x, y, g, _ = table(spark, 3, 160)
    w, cs = np.ones(len(x)), [0.001, 0.1, 10.0]
    got = {r["id"]: (r["c"], r["oof"]) for r in nested.nested_oof(df, "id", "g", ["a", "b", "c", "d"], "y", cs).collect()}

    def area(s, t):
        return np.mean([(p > n) + 0.5 * (p == n) for p in s[t == 1] for n in s[t == 0]])

    for o in range(4):
        rest = g != o
        values = []
        for c in cs:
            s = np.zeros(len(x))
            for i in set(range(4)) - {o}:
                s[g == i] = newton(x[rest & (g != i)], y[rest & (g != i)], w[rest & (g != i)], c, False)(x[g == i])
            values.append(round(area(np.round(s[rest], 12), y[rest]), 9))
        best = max(range(3), key=lambda k: (values[k], -k))
        want = newton(x[rest], y[rest], w[rest], cs[best], False)(x[g == o])
        own = np.flatnonzero(g == o)
        assert {got[i][0] for i in own} == {cs[best]} and np.allclose([got[i][1] for i in own], want, atol=1e-6)


def test_one_class_separable_and_empty(spark):
    schema = "id long, g string, a double, y int"
    one = spark.createDataFrame([(1, "p", 1.0, 1), (2, "q", 2.0, 1)], schema)
    assert {r["oof"] for r in nested.grouped_oof(one, "id", "g", ["a"], "y").collect()} == {0.5}
    apart = spark.createDataFrame([(i, f"g{i % 3}", float(i), int(i >= 30)) for i in range(60)], schema)
    got = {r["id"]: r["oof"] for r in nested.nested_oof(apart, "id", "g", ["a"], "y", [1.0, 1e6]).collect()}
    assert all((got[i] > 0.5) == (i >= 30) for i in range(60) if not 27 <= i <= 32)
    assert nested.nested_oof(one.limit(0), "id", "g", ["a"], "y", [1.0]).collect() == []
    with pytest.raises(ValueError):
        nested.grouped_oof(spark.createDataFrame([(i, f"g{i}", 1.0, 1) for i in range(70)], schema), "id", "g", ["a"], "y")
