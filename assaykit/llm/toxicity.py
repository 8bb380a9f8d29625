"""Toxicity: a convolutional text classifier in numpy.

Words and their first six bytes are hashed into an embedding table and added; filters of widths 1, 2 and 3 run over the whole
text, each is max-pooled, and a logistic layer scores the pooled values. As only the best
place of each filter carries a gradient, training touches a few words of each text.
A filter is a sum of per-word terms, so scoring looks up precomputed terms, adds and pools.
The threshold is calibrated by language, which is guessed from the text itself:
scores are bent so that each language's threshold lies at 0.7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_rows, fold
from .textio import chunks, lowered, mix, small_batches, span_hashes, text_bytes

FIT_ROWS, FIT_BYTES = 6_000, 64_000_000
SLOTS, DIM, FILTERS, WIDTHS, STEM = 1 << 16, 8, 12, (1, 2, 3), 6
CUT = 0.7
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_WORD[128:] = True
# Frequent short words by which the language of a text is guessed.
GUESSES = {
    "en": "the of and to in is that it for was with on as be by this are from".split(),
    "de": "der die und das den von zu mit sich ist nicht ein auf im dem des".split(),
    "fr": "le la les et des un une du est que qui dans en pour pas sur au par".split(),
    "es": "el los las una que es por con para del se su no al lo como".split(),
}


def slots(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots (1..SLOTS-1) of each word of the chunk and of its stem (0 where it has none), and the index of each text's first word (n+1)."""
    low = lowered(body)
    inside = _WORD[low]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(body) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(body) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    whole = (span_hashes(low, starts, ends) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    stem = (mix(span_hashes(low, starts, np.minimum(starts + STEM, ends))) % np.uint64(SLOTS - 1)).astype(np.int64) + 1
    return np.stack([whole, np.where(ends - starts > STEM, stem, 0)], 1), np.searchsorted(starts, offsets)


def _guess_slots() -> np.ndarray:
    table = np.full(SLOTS, -1)
    for k, words in enumerate(GUESSES.values()):
        for w in words:
            s, _ = slots(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))
            table[s[0, 0]] = k
    return table


def languages(ids: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Guessed language of each text (index into GUESSES), -1 where no known word occurs."""
    n = len(first) - 1
    of = np.repeat(np.arange(n), np.diff(first))
    k = table[ids[:, 0]]
    votes = np.bincount(of[k >= 0] * len(GUESSES) + k[k >= 0], minlength=n * len(GUESSES)).reshape(n, -1)
    return np.where(votes.sum(1) > 0, votes.argmax(1), -1)


class ConvText:
    """Parameters of the network and the bends of its scores."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (SLOTS, DIM)).astype(np.float32)
        self.filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)
        self.cuts = np.full(len(GUESSES) + 1, CUT)
        self.guess = _guess_slots()
        self.tables: dict | None = None

    def terms(self) -> dict:
        if self.tables is None:
            self.tables = {w: [self.embed @ self.filters[w][k] for k in range(w)] for w in WIDTHS}
        return self.tables

    def pooled(self, ids: np.ndarray, first: np.ndarray, places: bool = False):
        """Max of every filter over each text (0 where a text has no word), and where it stood.

        Windows may begin up to width-1 slots before the text's end; slot 0 is the padding there.
        """
        n = len(first) - 1
        sizes = np.diff(first)
        padded = np.zeros((len(ids) + 2 * n, 2), np.int64)
        begin = first[:-1] + 2 * np.arange(n)
        padded[np.arange(len(ids)) + np.repeat(2 * np.arange(n), sizes)] = ids
        has = np.flatnonzero(sizes)
        values, where = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
        for j, w in enumerate(WIDTHS):
            tables = self.terms()[w]
            total = tables[0][padded[:, 0]] + tables[0][padded[:, 1]]
            for k in range(1, w):
                total[: len(padded) - k] += tables[k][padded[k:, 0]] + tables[k][padded[k:, 1]]
            bounds = np.stack([begin[has], begin[has] + sizes[has]], 1).ravel()
            if len(total):
                total = np.concatenate([total, np.full((1, FILTERS), -np.inf, np.float32)])
                most = np.maximum.reduceat(total, bounds, axis=0)[::2]
                values[has, j * FILTERS : (j + 1) * FILTERS] = np.maximum(most + self.bias[w], 0)
                if places:
                    for i, (lo, hi) in enumerate(zip(begin[has], (begin + sizes)[has], strict=True)):
                        where[has[i], j * FILTERS : (j + 1) * FILTERS] = lo + total[lo:hi].argmax(0)
        return (values, where, padded) if places else values

    def raw(self, ids, first) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(ids, first) @ self.out + self.shift, -30, 30).astype(float)))

    def predict(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bent scores: the threshold of the guessed language comes to lie at 0.7."""
        s = self.raw(ids, first)
        c = self.cuts[languages(ids, first, self.guess)]
        return np.where(s < c, CUT * s / c, CUT + (1 - CUT) * (s - c) / (1 - c))


def fit(texts: list[str], y: np.ndarray, epochs: int = 8, batch: int = 128, least_steps: int = 240, rate: float = 0.02, seed: int = 11) -> ConvText:
    """Adam on the logistic loss; words in fewer than one of 400 texts (two at least) stay at the padding's zero."""
    net = ConvText(seed)
    net.embed[0] = 0
    data = [slots(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts]
    y = np.asarray(y, float)
    if len(y) < 8 or y.min() == y.max():
        net.embed[:] = 0
        net.tables = None
        net.shift = np.float32(np.log((y.sum() + 0.1) / (len(y) - y.sum() + 1.0)) if len(y) else -2)
        return net
    seen, toxic = np.zeros(SLOTS), np.zeros(SLOTS)
    for ids, label in zip(data, y, strict=True):
        u = np.unique(ids)
        seen[u] += 1
        toxic[u] += label
    # The first component starts from how much more often a word stands in toxic texts.
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((seen - toxic + 0.5) / (len(y) - y.sum() + 1))
    z = odds * np.sqrt(np.minimum(seen, 40) / 40)
    known = seen >= max(2, len(y) // 400)
    known[0] = False
    net.embed[:, 0] += np.clip(z, -2, 2).astype(np.float32)
    net.embed[~known] = 0
    for w in WIDTHS:
        net.filters[w][0, 0] = np.abs(net.filters[w][0, 0]) + 0.5
    net.out = np.abs(net.out)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    n_fit = max(1, int(len(y) * 0.8))
    own, other = order[:n_fit], order[n_fit:]
    weight = np.where(y > 0, 0.5 / max(y[own].mean(), 1e-3), 0.5 / max(1 - y[own].mean(), 1e-3)) ** 0.5
    params = {"embed": net.embed, "out": net.out, **{f"f{w}": net.filters[w] for w in WIDTHS}, **{f"b{w}": net.bias[w] for w in WIDTHS}}
    m, v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
    step = 0
    batch = max(16, min(batch, len(own) // 40))
    epochs = max(epochs, min(30, least_steps * batch // max(1, len(own))))
    for _ in range(epochs):
        rng.shuffle(own)
        for at in range(0, len(own), batch):
            pick = own[at : at + batch]
            ids = np.concatenate([data[i] for i in pick])
            first = np.concatenate([[0], np.cumsum([len(data[i]) for i in pick])])
            net.tables = None
            values, where, padded = net.pooled(ids, first, places=True)
            p = 1 / (1 + np.exp(-np.clip(values @ net.out + net.shift, -30, 30)))
            d = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            grads = {"out": values.T @ d + 1e-4 * net.out}
            back = d[:, None] * net.out[None, :] * (values > 0)
            g_embed = np.zeros_like(net.embed)
            for j, w in enumerate(WIDTHS):
                b = back[:, j * FILTERS : (j + 1) * FILTERS]
                spots = where[:, j * FILTERS : (j + 1) * FILTERS]
                g_f = np.zeros_like(net.filters[w])
                for k in range(w):
                    words = padded[np.minimum(spots + k, len(padded) - 1)]
                    g_f[k] = np.einsum("nfd,nf->df", net.embed[words].sum(2), b)
                    back_to = (b[:, :, None] * net.filters[w][k].T[None]).reshape(-1, DIM)
                    for part in (0, 1):
                        np.add.at(g_embed, words[:, :, part].ravel(), back_to)
                grads[f"f{w}"], grads[f"b{w}"] = g_f + 1e-4 * net.filters[w], b.sum(0)
            g_embed[~known] = 0
            grads["embed"] = g_embed
            net.shift -= np.float32(rate * d.sum() * 5)
            step += 1
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
            net.embed[~known] = 0
        rate *= 0.8 ** (8 / epochs)
    net.tables = None
    # Thresholds: the best F1 on the rows left out of the fit, by guessed language where it has enough of both classes.
    ids = np.concatenate([data[i] for i in other]) if len(other) else np.zeros((0, 2), np.int64)
    first = np.concatenate([[0], np.cumsum([len(data[i]) for i in other])]).astype(np.int64)
    if len(other):
        s, lang, t = net.raw(ids, first), languages(ids, first, net.guess), y[other]
        overall = _threshold(s, t, 0.5) if t.sum() >= 15 else 0.5  # too few to choose by
        for k in range(-1, len(GUESSES)):
            mine = lang == k
            net.cuts[k] = _threshold(s[mine], t[mine], overall) if t[mine].sum() >= 8 and (1 - t[mine]).sum() >= 8 else overall
    net.terms()
    return net


def _threshold(s: np.ndarray, t: np.ndarray, default: float) -> float:
    if not len(t) or t.min() == t.max():
        return default
    grid = np.linspace(0.05, 0.95, 91)
    hit = s[:, None] >= grid[None]
    f1 = 2 * (hit * t[:, None]).sum(0) / np.maximum(1, hit.sum(0) + t.sum())
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(grid[good[len(good) // 2]])


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> ConvText:
    """Fit on at most ``most`` labelled rows and ``FIT_BYTES`` of text outside the held-out fold; only these texts come to the driver."""
    rows = sorted(fit_rows(docs, labels, "toxic", most, most_bytes=FIT_BYTES).collect(), key=lambda r: (r["id"], r["text"]))
    return fit([r["text"] for r in rows], np.array([r["y"] for r in rows], float))


def score_toxicity(docs: DataFrame, model: ConvText) -> DataFrame:
    """``doc_id, held_out, score, predicted`` (1 from 0.7) for every row and its whole text.

    Null and empty texts get the score of no words. Without usable labels all scores are the prior. Repeated
    rows score alike. No shuffle; a worker holds one chunk of texts and the tables of the filters.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        net = sent.value
        for batch in batches:
            body, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, 1_000_000):
                ids, first = slots(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(net.predict(ids, first))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
