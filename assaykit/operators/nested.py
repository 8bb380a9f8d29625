"""Many logistic models in one pass: Newton sums of all of them by one aggregate a step.

A model is fitted on the rows of some groups with some C. Every step each task reads its rows once, adds them to the gradients and
Hessians of all models that may see them, and sends one partial sum for each; the driver solves systems of the size of the features.
So leave-one-group-out scores, and the choice of C within each of them, take as many jobs as the slowest model has steps,
whatever the number of groups, inner groups and values of C.
"""

from __future__ import annotations

import dataclasses
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrowtext import cut
from .metrics import auroc

STEPS, TOLERANCE = 60, 1e-10
MOST_GROUPS, MOST_FEATURES = 64, 128  # what all models hold: groups**2 * len(C) * features**2 numbers


@dataclasses.dataclass
class Model:
    """Coefficients in the units of the features, intercept first; ``hidden`` groups are not seen, ``c`` weighs the loss against the norm."""

    hidden: tuple[int, ...]
    c: float
    mean: np.ndarray
    scale: np.ndarray
    class_weight: np.ndarray
    beta: np.ndarray
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + ((x - self.mean) / self.scale) @ self.beta[1:], -700, 700)))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
    return batch.column("g").to_numpy(), x, batch.column("y").to_numpy(), batch.column("w").to_numpy()


def _moments(batches):
    """Of each group and label: rows, weight, sums of the features and of their squares."""
    for batch in batches:
        g, x, y, w = _matrix(batch)
        for group, label in sorted(set(zip(g.tolist(), y.tolist(), strict=True))):
            own = (g == group) & (y == label)
            values = np.concatenate([[own.sum(), w[own].sum()], x[own].sum(0), (x[own] ** 2).sum(0)])
            n = len(values)
            yield pa.RecordBatch.from_arrays([pa.array([group] * n, pa.int32()), pa.array([label] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(values)], names=["g", "y", "i", "s"])


def _newton(batches, models: list[Model], live: list[int]):
    """Loss, gradient and Hessian of each live model, without the penalty."""
    size = len(models[0].beta)
    total = np.zeros((len(live), 1 + size + size * size))
    some = False
    for batch in batches:
        g, x, y, w = _matrix(batch)
        some = some or len(g) > 0
        for row, m in enumerate(live):
            model = models[m]
            seen = ~np.isin(g, model.hidden)
            z = np.hstack([np.ones((int(seen.sum()), 1)), (x[seen] - model.mean) / model.scale])
            t, v = y[seen], w[seen] * model.class_weight[y[seen].astype(int)]
            margin = z @ model.beta
            p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            total[row, 0] += (v * (np.logaddexp(0, margin) - t * margin)).sum()
            total[row, 1 : 1 + size] += z.T @ (v * (p - t))
            total[row, 1 + size :] += ((z * (v * p * (1 - p))[:, None]).T @ z).ravel()
    if some:
        m, i = (a.ravel().astype(np.int32) for a in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(live, np.int32)[m]), pa.array(i), pa.array(total.ravel())], names=["m", "i", "s"])


def fit_all(rows: DataFrame, asked: list[tuple[tuple[int, ...], float]], balanced: bool, standardise: bool) -> list[Model]:
    """A model for each (hidden groups, C), of ``rows (g int, x array<double>, y double, w double)``.

    A model that sees one class only has a constant score of 0.5. Constant features get no weight.
    """
    sums: dict[tuple[int, float], np.ndarray] = {}
    for r in rows.mapInArrow(_moments, "g int, y double, i int, s double").groupBy("g", "y", "i").agg(F.sum("s").alias("s")).collect():
        sums.setdefault((r["g"], r["y"]), {})[r["i"]] = r["s"]
    parts = {k: np.array([v[i] for i in range(len(v))]) for k, v in sums.items()}
    width = (len(next(iter(parts.values()))) - 2) // 2
    models = []
    for hidden, c in asked:
        by = [sum((v for (g, y), v in parts.items() if g not in hidden and y == label), np.zeros(2 + 2 * width)) for label in (0.0, 1.0)]
        both = by[0] + by[1]
        n = max(both[0], 1.0)
        mean = both[2 : 2 + width] / n if standardise else np.zeros(width)
        spread = np.sqrt(np.maximum(both[2 + width :] / n - mean**2, 0.0)) if standardise else np.ones(width)
        one = by[0][0] == 0 or by[1][0] == 0
        weight = np.array([both[1] / (2 * v[1]) if balanced and v[1] else 1.0 for v in by])
        models.append(Model(tuple(hidden), c, mean, np.where(spread > 1e-12, spread, np.inf), weight, np.zeros(width + 1), 0.5 if one else None))
    live = [i for i, m in enumerate(models) if m.constant is None]
    best = {i: np.inf for i in live}
    step = {i: np.zeros(width + 1) for i in live}
    for _ in range(STEPS):
        if not live:
            break
        now = list(live)
        got: dict[int, dict[int, float]] = {}
        for r in rows.mapInArrow(lambda b, now=now: _newton(b, models, now), "m int, i int, s double").groupBy("m", "i").agg(F.sum("s").alias("s")).collect():
            got.setdefault(r["m"], {})[r["i"]] = r["s"]
        for i in now:
            model, v = models[i], np.array([got[i][k] for k in range(len(got[i]))])
            size = width + 1
            ridge = np.r_[0.0, np.full(width, 1 / model.c)]
            loss = v[0] + (ridge * model.beta**2).sum() / 2
            if loss > best[i] + 1e-9 * abs(best[i]):  # too far: half the way back
                step[i] /= 2
                model.beta = model.beta - step[i]
                continue
            best[i] = loss
            gradient = v[1 : 1 + size] + ridge * model.beta
            hessian = v[1 + size :].reshape(size, size) + np.diag(ridge)
            step[i] = -np.linalg.solve(hessian + 1e-12 * np.eye(size), gradient)
            model.beta = model.beta + step[i]
            if np.abs(step[i]).max() < TOLERANCE:
                live.remove(i)
    return models


def _prepared(df: DataFrame, key: str, group: str, features: list[str], label: str, weight: str | None) -> tuple[DataFrame, list]:
    known = df.filter(F.col(group).isNotNull() & F.col(label).isin(0, 1))
    for c in features:
        known = known.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    groups = sorted(r[0] for r in known.select(group).distinct().limit(MOST_GROUPS + 1).collect())
    if len(groups) > MOST_GROUPS or len(features) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_GROUPS} groups or {MOST_FEATURES} features: deal the groups to folds first, or choose features")
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group)) - 1 if groups else F.lit(0)
    x = F.array(*[F.col(c).cast("double") for c in features])
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    return cut(known.select(F.col(key).alias("__key"), place.cast("int").alias("g"), x.alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))), groups


def _scored(rows: DataFrame, models: dict[tuple[int, int], Model], names: list[int]) -> DataFrame:
    """``__key, g, y, n, score``: each row by the model of (name, its group), for each name that has one."""
    kind = dict(rows.dtypes)["__key"]

    def run(batches):
        for batch in batches:
            g, x, y, _ = _matrix(batch)
            for name in names:
                out = np.full(len(g), np.nan)
                for own in np.unique(g):
                    model = models.get((name, int(own)))
                    if model is not None:
                        out[g == own] = model.scores(x[g == own])
                kept = pa.array(~np.isnan(out))
                columns = [batch.column(0), batch.column("g"), batch.column("y"), pa.array(np.full(len(g), name, np.int32)), pa.array(out)]
                yield pa.RecordBatch.from_arrays([c.filter(kept) for c in columns], names=["__key", "g", "y", "n", "score"])

    return rows.select("__key", "g", "x", "y", "w").mapInArrow(run, f"__key {kind}, g int, y double, n int, score double")


def grouped_oof(df: DataFrame, key: str, group: str, features: list[str], label: str, c: float = 1.0, weight: str | None = None, balanced: bool = False, standardise: bool = True) -> DataFrame:
    """``key, oof``: every row by a model of the other groups; all groups in one pass a step. Rows without a group, label or feature are left out."""
    rows, groups = _prepared(df, key, group, features, label, weight)
    if not groups:
        return rows.select(F.col("__key").alias(key), F.lit(None).cast("double").alias("oof"))
    models = fit_all(rows, [((i,), c) for i in range(len(groups))], balanced, standardise)
    return _scored(rows, {(0, i): m for i, m in enumerate(models)}, [0]).select(F.col("__key").alias(key), F.col("score").alias("oof"))


def nested_oof(df: DataFrame, key: str, group: str, features: list[str], label: str, cs: list[float], weight: str | None = None, balanced: bool = False, standardise: bool = True) -> DataFrame:
    """``key, c, oof``: every row by a model of the other groups, whose C is the best among those groups alone.

    For each outer group and C every inner group is scored by a model of the rest; the C with the greatest AUROC over all inner
    rows is taken (rounded to nine digits, ties to the smaller C; without both classes the smallest). Inner and outer
    models of all groups and all C are fitted together.
    """
    rows, groups = _prepared(df, key, group, features, label, weight)
    cs, k = sorted(cs), len(groups)
    if not groups:
        return rows.select(F.col("__key").alias(key), F.lit(None).cast("double").alias("c"), F.lit(None).cast("double").alias("oof"))
    inner = [((o, i), c) for o, i, c in itertools.product(range(k), range(k), range(len(cs))) if o != i]
    outer = [((o,), c) for o, c in itertools.product(range(k), range(len(cs)))]
    models = fit_all(rows, [(hidden, cs[c]) for hidden, c in inner + outer], balanced, standardise)
    by_name: dict[tuple[int, int], Model] = {}
    for (hidden, c), model in zip(inner + outer, models, strict=True):
        if len(hidden) == 2:
            by_name[hidden[0] * len(cs) + c, hidden[1]] = model
    names = sorted({n for n, _ in by_name})
    found = {}
    if names:
        scored = _scored(rows, by_name, names).select(F.col("n").alias("unit"), F.col("y").cast("int").alias("label"), F.round("score", 12).alias("score"))
        found = {r["unit"]: r["auroc"] for r in auroc(scored, ["unit"]).collect()}
    final = {}
    for o in range(k):
        value = lambda c, o=o: (round(found.get(o * len(cs) + c) or 0.0, 9), -c)
        best = max(range(len(cs)), key=value)
        final[best, o] = models[len(inner) + o * len(cs) + best]
    out = _scored(rows, final, sorted({n for n, _ in final}))
    chosen = F.element_at(F.array(*[F.lit(float(c)) for c in cs]), F.col("n") + 1)
    return out.select(F.col("__key").alias(key), chosen.alias("c"), F.col("score").alias("oof"))
