"""Quality classifier: histogram gradient-boosted trees over statistics of the document.

Features are counted from the UTF-8 bytes of whole texts. Trees are grown level by
level from histograms of binned features and flattened into arrays; scoring walks all
trees of a batch at once by indexing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_rows, fold
from .textio import chunks, mix, small_batches, span_hashes, text_bytes, tidy, word_bounds

FIT_ROWS = 12_000
FEATURES = (
    "log_bytes log_words mean_word sd_word upper lower digit space newline wide quotes exclaim pipe symbol stop_mark comma other "
    "distinct_words top_word repeat_next repeat_second capital_words marked_words log_lines words_a_line distinct_lines"
).split()

_CLASS = np.full(256, 11, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", bytes(range(128, 256)), b"'\"`", b"!", b"|", b"#$%&*@^~<>=+{}[]\\_/", b".?;:")):
    _CLASS[list(_chars)] = _k
_CLASS[ord(",")] = 12
_N_CLASS = 13


def features(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; empty texts have zeros."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(body):
        return out
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    counts = np.bincount(doc * _N_CLASS + _CLASS[body], minlength=n * _N_CLASS).reshape(n, _N_CLASS).astype(float)
    starts, ends, first = word_bounds(body, offsets)
    n_words = np.diff(first)
    some = np.maximum(sizes, 1)
    out[:, 0] = np.log1p(sizes)
    out[:, 1] = np.log1p(n_words)
    words = np.maximum(n_words, 1)
    length = (ends - starts).astype(float)
    of = np.repeat(np.arange(n), n_words)
    out[:, 2] = np.bincount(of, length, n) / words
    out[:, 3] = np.sqrt(np.maximum(0, np.bincount(of, length * length, n) / words - out[:, 2] ** 2))
    shares = counts / some[:, None]
    for k, c in enumerate((0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 11)):
        out[:, 4 + k] = shares[:, c]
    h = span_hashes(body, starts, ends)
    if len(h):
        key = np.sort((mix(h) >> np.uint64(32)) | (of.astype(np.uint64) << np.uint64(32)))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        runs = np.diff(np.concatenate([new, [len(key)]]))
        owner = (key[new] >> np.uint64(32)).astype(np.int64)
        out[:, 17] = np.bincount(owner, minlength=n) / words
        top = np.zeros(n)
        np.maximum.at(top, owner, runs)
        out[:, 18] = top / words
        for k, step in ((19, 1), (20, 2)):
            same = (h[step:] == h[:-step]) & (of[step:] == of[:-step])
            out[:, k] = np.bincount(of[step:][same], minlength=n) / words
        kind = _CLASS[body]
        tail, head = kind[ends - 1], kind[starts]
        second = kind[np.minimum(starts + 1, len(body) - 1)]
        out[:, 21] = np.bincount(of[(head == 0) & (second == 0) & (length > 1)], minlength=n) / words
        out[:, 22] = np.bincount(of[(tail == 9) | (tail == 7)], minlength=n) / words
    # Lines: spans between newlines.
    breaks = np.flatnonzero(body == 10)
    edges = np.unique(np.concatenate([breaks + 1, offsets[:-1][sizes > 0]]))
    edges = edges[edges < len(body)]
    line_doc = doc[edges]
    stop = np.concatenate([edges[1:], [len(body)]])
    lines = np.bincount(line_doc, minlength=n)
    out[:, 23] = np.log1p(lines)
    out[:, 24] = n_words / np.maximum(lines, 1)
    lh = span_hashes(body, edges, stop)
    lk = np.unique((lh >> np.uint64(32)) | (line_doc.astype(np.uint64) << np.uint64(32)))
    out[:, 25] = np.bincount((lk >> np.uint64(32)).astype(np.int64), minlength=n) / np.maximum(lines, 1)
    return out


class BoostedTrees:
    """Binary logistic boosting on histograms; trees lie flat in arrays of features, cuts and values."""

    def __init__(self, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, smooth: float = 2.0, least: float = 3.0):
        self.n_trees, self.depth, self.rate, self.bins, self.smooth, self.least = n_trees, depth, rate, bins, smooth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        share = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-3), 1 - 1e-3) if n else 0.5
        self.start = float(np.log(share / (1 - share)))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((self.n_trees, size), np.int64)
        self.cut = np.full((self.n_trees, size), np.inf)
        self.value = np.zeros((self.n_trees, size))
        if not n or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(f)]
        binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(f)], 1)
        raw = np.full(n, self.start)
        place = np.arange(f) * self.bins
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                lo = 2**level - 1
                width = 2**level
                flat = ((node - lo)[:, None] * (f * self.bins) + place + binned).ravel()
                hist = [np.bincount(flat, np.repeat(v, f), width * f * self.bins).reshape(width, f, self.bins).cumsum(2) for v in (g, h)]
                total = [v[:, :1, -1:] for v in hist]
                gl, hl = hist
                gr, hr = total[0] - gl, total[1] - hl
                gain = gl**2 / (hl + self.smooth) + gr**2 / (hr + self.smooth) - total[0] ** 2 / (total[1] + self.smooth)
                gain[(hl < self.least * 0.25) | (hr < self.least * 0.25)] = -1
                best = gain.reshape(width, -1).argmax(1)
                for j in range(width):
                    k, b = divmod(int(best[j]), self.bins)
                    if gain[j].flat[best[j]] > 1e-9 and b < len(edges[k]):
                        self.feature[t, lo + j], self.cut[t, lo + j] = k, edges[k][b]
                    # where no split helps the cut stays infinite and all rows go left
                k = self.feature[t, node]
                node = 2 * node + 1 + (x[np.arange(n), k] > self.cut[t, node])
            lo = 2**self.depth - 1
            gs, hs = np.bincount(node - lo, g, 2**self.depth), np.bincount(node - lo, h, 2**self.depth)
            self.value[t, lo:] = -self.rate * gs / (hs + self.smooth)
            raw += self.value[t, node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Scores in 0..1: all trees of all rows step down together."""
        trees, rows = np.arange(self.n_trees), np.arange(len(x))[:, None]
        node = np.zeros((len(x), self.n_trees), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return 1 / (1 + np.exp(-(self.start + self.value[trees, node].sum(1))))


def with_features(df: DataFrame, keep: list[str], score=None) -> DataFrame:
    """``keep`` columns and ``x`` (features) or, with a model, ``score``; one pass, no shuffle."""
    small_batches(df.sparkSession)
    own = ["text"] if "text" in keep and dict(df.dtypes)["text"] == "string" else []
    df = df.select(*keep, *([] if own else [F.col("text").cast("string").alias("__text")]))
    at_text = keep.index("text") if own else len(keep)
    kind = "double" if score else "array<double>"
    name = "score" if score else "x"

    def run(batches):
        for batch in batches:
            body, offsets = text_bytes(batch.column(at_text))
            for a, b in chunks(offsets):
                x = features(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                made = pa.array(score.predict(x)) if score else pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[: len(keep)]], made], names=[*keep, name])

    return df.mapInArrow(tidy(run), df.drop("__text").limit(0).withColumn(name, F.lit(None).cast(kind)).schema)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> BoostedTrees:
    """Fit on at most ``most`` labelled rows outside the held-out fold; only their features come to the driver."""
    rows = with_features(fit_rows(docs, labels, "quality", most), ["id", "y"]).toPandas().sort_values("id")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return BoostedTrees().fit(x, rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: BoostedTrees, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id by default) plus ``held_out``, ``score`` and ``predicted`` for every row.

    Null and empty texts have zero features and the score the trees give these. Without usable labels every
    score is the prior 0.5. Repeated rows score alike; other columns are never read for the score.
    """
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kilobytes whatever the data

    class Sent:
        def predict(self, x):
            return sent.value.predict(x)

    named = docs.withColumn("__id", F.col("doc_id"))
    out = with_features(named, ["__id", *keep], Sent())
    return out.withColumn("held_out", F.coalesce(fold("__id") == 1, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("__id")
