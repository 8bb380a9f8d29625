"""Whitening of vectors by the spectral divide-and-conquer of their covariance.

The covariance is summed over all vectors in exact integers. Its eigenvectors come from polar decompositions: for a symmetric
A and a shift s, the polar factor U of A - s I has the eigenvalues +1 and -1, so (I + U) / 2 projects on the eigenvectors
above the shift. An orthogonal basis of both ranges splits A in two blocks, which are split again until each is one
component. The polar factor is found by the dynamically weighted Halley iteration in its QR form (QDWH), which needs no
inverse and at most six or seven steps. The components, d x k numbers, are broadcast, and every row is projected on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**40  # of a scaled entry; beyond it sums of squares would leave the range of whole doubles at once
_EPS = np.finfo(float).eps


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, non-singular matrix by QDWH."""
    n = len(a)
    alpha = np.linalg.norm(a)  # at least the largest singular value
    x = a / alpha
    # A lower bound of the smallest singular value: from R of a QR factorisation, with a margin.
    r = np.linalg.qr(x, mode="r")
    low = max(1 / (np.linalg.norm(np.linalg.pinv(r)) * np.sqrt(n)) * 0.9, _EPS)
    eye = np.eye(n)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        ha = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        hb = (ha - 1) ** 2 / 4
        hc = ha + hb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(hc) * x, eye]))
        new = hb / hc * x + (ha - hb / hc) / np.sqrt(hc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (ha + hb * low**2) / (1 + hc * low**2))
        if moved <= 5 * np.cbrt(_EPS) and 1 - low <= 10 * _EPS:
            break
    return x


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors of a above and below the shift; None where the shift doesn't part them cleanly."""
    n = len(a)
    u = polar_factor(a - shift * np.eye(n))
    projector = (u + np.eye(n)) / 2
    k = int(round(np.trace(projector)))
    if not 0 < k < n:
        return None
    # k random columns, projected twice, span the range; the rest of the space is the range of the other projector.
    q = np.linalg.qr(projector @ np.random.default_rng(n).standard_normal((n, k)))[0]
    full = np.linalg.qr(np.hstack([projector @ q, np.random.default_rng(k).standard_normal((n, n - k))]))[0]
    above, below = full[:, :k], full[:, k:]
    off = np.linalg.norm(below.T @ a @ above)
    return (above, below) if off <= 1e-9 * max(np.linalg.norm(a), _EPS) else None


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix by recursive splitting."""
    n = len(a)
    scale = np.linalg.norm(a)
    values, vectors = [], []

    def divide(block: np.ndarray, basis: np.ndarray) -> None:
        size = len(block)
        mean = np.trace(block) / size if size else 0.0
        if size == 1 or np.linalg.norm(block - mean * np.eye(size)) <= 4 * size * _EPS * scale:
            values.extend(np.diag(block))  # equal eigenvalues: any basis serves
            vectors.extend(basis.T)
            return
        # The mean of the spectrum has eigenvalues on both sides; other shifts in case it is one itself.
        spread = np.linalg.norm(block - mean * np.eye(size)) / np.sqrt(size)
        for step in (0.0, 0.1, -0.1, 0.3, -0.3, 0.03, -0.03, 0.6, -0.6):
            parts = _split(block, mean + step * spread)
            if parts:
                for part in parts:
                    inner = part.T @ block @ part
                    divide((inner + inner.T) / 2, basis @ part)
                return
        raise ArithmeticError("no shift splits the spectrum")

    divide((a + a.T) / 2, np.eye(n))
    v = np.array(vectors).T if vectors else np.zeros((n, 0))
    e = np.einsum("ij,ij->j", v, a @ v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def _whole(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``vec_id, x``: vectors without null or non-finite entries (or beyond ``LARGEST``) as whole numbers."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LARGEST))
    x = F.when(v.isNotNull() & sound, F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + OFFSET))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter("x IS NOT NULL")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as whole numbers; those of fewer entries are filled up with entries of zero."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(at)
    out = np.full((len(sizes), width), OFFSET, np.int64)
    if len(flat):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], sizes)] = flat
    return out


def _pair_sums(rows: DataFrame, projected, kind: str) -> tuple[dict, int]:
    """Sums over all rows of each product of two columns and (j = -1) of each column; one partial matrix leaves a task."""

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                z = projected(batch.slice(at, 4096).column(0))
                part = np.hstack([z.T @ z, z.sum(0)[:, None]])
                total = part if total is None else total + part
        if total is not None:
            i, j = (x.astype(np.int32) for x in np.nonzero(np.triu(np.ones(total.shape, bool))))
            columns = [pa.array(i), pa.array(np.where(j == len(total), -1, j).astype(np.int32)), pa.array(total[i, j])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "s"])

    sums = rows.select("x").mapInArrow(run, f"i int, j int, s {kind}").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return {(r["i"], r["j"]): r["s"] for r in sums}


def _covariance(sums: dict, width: int, n: int) -> np.ndarray:
    means = np.array([sums[i, -1] / n for i in range(width)])
    out = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            out[i, j] = out[j, i] = sums[i, j] / n - means[i] * means[j]
    return out


def whiten(df: DataFrame, k: int = 32, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component up to k.

    Vectors that are null or hold null or non-finite entries (or entries of 2**34 and more) are left out; a null id stays, and
    repeated rows each count. Shorter vectors are filled up with zeros. ``whitened`` is null for components without
    variance (constant or single vectors), which take no part in ``identity_error``; ``explained`` is null if there is no
    variance at all, ``deviation`` if it is beyond a long. An empty table gives no rows. Three aggregates over the rows (sums,
    products, the check of the result); what reaches the driver is d * d numbers, whatever the number of rows.
    """
    spark = df.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _whole(df, id_col, vector)
    place = F.posexplode("x").alias("i", "x")
    got = rows.select(place).groupBy("i").agg(F.count(F.lit(1)).alias("c"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    n = rows.count() if got else 0
    if not n:
        return spark.createDataFrame([], schema)
    width = len(got)
    sums = [0] * width
    reach = 0
    for r in got:
        fill = n - r["c"]
        sums[r["i"]] = r["s"] + fill * OFFSET
        lo, hi = (min(r["lo"], OFFSET), max(r["hi"], OFFSET)) if fill else (r["lo"], r["hi"])
        reach += max(abs(n * lo - sums[r["i"]]), abs(n * hi - sums[r["i"]])) ** 2
    centre = np.array([s // n for s in sums], np.int64)  # whole numbers next to the means: centred products stay exact
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])
    exact = n * max(int(np.abs(np.array([[r["lo"], r["hi"]] for r in got]) - OFFSET).max()) * 2, 1) ** 2 < 2**62
    kind = (np.int64, "long") if exact else (np.float64, "double")
    covariance = _covariance(_pair_sums(rows, lambda c: (_matrix(c, width) - centre).astype(kind[0]), kind[1]), width, n)
    values, vectors = components(covariance)
    k = min(k, width)
    values, vectors = values[:k], vectors[:, :k]
    trace = float(np.trace(covariance))
    live = values > max(width, 1) * 16 * _EPS * max(trace, 0.0)
    weights = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
    sent = spark.sparkContext.broadcast((centre, rest, weights))
    project = lambda c: ((_matrix(c, width) - sent.value[0]) - sent.value[1]) @ sent.value[2]
    found = _covariance(_pair_sums(rows, project, "double"), k, n)
    error = float(np.abs((found - np.eye(k))[np.ix_(live, live)]).max(initial=0.0))
    explained = [float(v) / trace if trace > 0 else None for v in values]
    fits = reach < 2**63
    short = (np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], np.int64), live, explained, error)

    def run(batches):
        below, living, share, worst = short
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                m = part.num_rows
                white = project(part.column(1)).ravel()
                y = n * (_matrix(part.column(1), width) - sent.value[0]) - below if fits else None
                away = pa.array(np.repeat((y * y).sum(1), k)) if fits else pa.nulls(m * k, pa.int64())
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), m)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(number), pa.array(np.full(m * k, n, np.int64)), away, pa.array(white, mask=~np.tile(living, m)), pa.array(share * m, pa.float64()), pa.array(np.full(m * k, worst))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
