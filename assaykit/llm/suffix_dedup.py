"""Removal of repeated byte strings by a sampled suffix order.

A byte goes if a string of ``span`` bytes (400 unless told otherwise) that covers it also
starts anywhere else. Every such window has one anchor: the leftmost smallest hash among its
32-byte tokens, which depends on the window alone. Only the suffixes at anchors are ordered
(about one in 185 for 400 bytes), by their leading token: equal windows have equal anchors,
so a window can only repeat where its anchor's token does.

An anchor's context is all the bytes of its windows. Contexts that are equal repeat as a
whole and are only counted. The most frequent of them (at most ``MOST_HOT``, a megabyte) are
known to every task, which joins their neighbouring places in a document to one span on the
spot; the places of the others are selected by a join. Contexts that are unlike any other but share their leading
token are sent, with one of each counted kind, to buckets made by sampled splitters of the
token; a bucket sorts its windows by multikey quicksort on tokens of 100 bytes, in which
only ties go on to the next token, and compares neighbours. Splitters fall between different leading tokens, so no
window has an equal beyond its bucket; a token with more contexts than a bucket should hold
is resolved by counting its windows over all tasks instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import among, chunks, cut, cut_parts, mix, powers, small_batches, text_bytes, tidy, word_bounds

SPAN, TOKEN = 400, 32
PASSAGE_SPAN, PASSAGE_WORDS = 200, 51  # passages of over 50 words; as bytes, words of under three letters on average are too short
HOT, MOST_HOT = 64, 1 << 16  # contexts found this often are resolved without a join; the choice never changes the result
PIECE = 250_000
_POSITION_BITS = 23
PARTS = 4  # tokens of a window in the multikey sort
MOST_BROADCAST_ENTRIES = 1_000_000  # contexts or span ends, up to 48 bytes each, that are sent to all tasks at a time
MOST_IN_BUCKET = 16_384  # contexts of one leading token that one task compares
ROWS_A_BUCKET = 8_192
_U = np.uint64
_rng = np.random.default_rng(20250117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


class Rolling:
    """Hashes of any span of a piece of text in constant time."""

    def __init__(self, body: np.ndarray):
        up, self.down = powers(len(body) + 1)
        self.total = np.empty(len(body) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(_BYTE[body] * up[: len(body)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + _U(0x9E3779B9) * (ends - starts).astype(np.uint64))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys: prefix and suffix minima of blocks of that width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(body: np.ndarray, offsets: np.ndarray, span: int, token: int = TOKEN):
    """(row, token hash, context hash, first window, last window, anchor) of every anchor, places within its row.

    The context of an anchor is all the bytes of its windows; equal contexts have equal windows.
    """
    if len(body) < span:
        return [np.zeros(0, np.int64)] * 6
    roll = Rolling(body)
    starts = np.arange(len(body) - token + 1)
    hashes = roll(starts, starts + token)
    keys = (hashes >> _U(_POSITION_BITS) << _U(_POSITION_BITS)) | starts.astype(np.uint64)
    least = (sliding_least(keys, span - token + 1) & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    valid = np.zeros(len(least) + 1, bool)
    # Windows may not cross into the next row.
    step = np.zeros(len(body) + 2, np.int32)
    long_ = sizes >= span
    np.add.at(step, offsets[:-1][long_], 1)
    np.add.at(step, offsets[1:][long_] - span + 1, -1)
    valid[: len(least)] = np.cumsum(step)[: len(least)] > 0
    first = np.zeros(len(least) + 1, bool)
    first[1 : len(least)] = least[1:] != least[:-1]
    first[:1] = True
    first[1 : len(least)] |= ~valid[: len(least) - 1]
    row_starts = offsets[:-1][long_]
    first[row_starts] = True
    lo = np.flatnonzero(first & valid)
    ends = np.flatnonzero((first | ~valid))
    hi = ends[np.searchsorted(ends, lo, side="right")] - 1 if len(lo) else lo
    at = least[lo]
    row = np.searchsorted(offsets, lo, side="right") - 1
    context = mix(roll(lo, hi + span) ^ mix((at - lo).astype(np.uint64)))
    base = offsets[row]
    return row, hashes[at], context, lo - base, hi - base, at - base


def pieces_of(body: np.ndarray, offsets: np.ndarray, overlap: int):
    """Chunks of rows; a row beyond ``PIECE`` bytes comes in pieces that share ``overlap`` bytes, each with its place."""
    for a, b in chunks(offsets, PIECE):
        if b - a == 1 and offsets[b] - offsets[a] > 2 * PIECE:
            n = int(offsets[b] - offsets[a])
            for at in range(0, n - overlap, PIECE):
                to = min(n, at + PIECE + overlap)
                yield a, b, at, body[offsets[a] + at : offsets[a] + to], np.array([0, to - at])
        else:
            yield a, b, 0, body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _anchor_rows(batches, span: int):
    for batch in batches:
        key = batch.column(0).to_numpy()
        body, offsets = text_bytes(batch.column(1))
        for a, b, at, part, bounds in pieces_of(body, offsets, span - 1):
            row, token, context, lo, hi, p = anchors(part, bounds, span)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(context.view(np.int64)), pa.array(key[a:b][row]), pa.array((lo + at).astype(np.int64)), pa.array((hi - lo).astype(np.int32))],
                names=["ah", "ch", "k", "lo", "more"],
            )


def _joined(row: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Overlapping or touching ranges [lo, hi) of each row as one: (row, lo, hi), in order."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    stride = int(hi.max(initial=0)) + 1  # rows laid out one behind the other, so one running maximum serves all
    begin, reach = row * stride + lo, np.maximum.accumulate(row * stride + hi)
    new = np.concatenate([[True], begin[1:] > reach[:-1]]) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1 if len(first) else first
    return row[first], lo[first], reach[last] - row[first] * stride


def _by_heat(batches, sent, wanted: bool):
    """Anchor rows without the hot contexts, or the windows of the hot ones, neighbours of one document as one row."""
    hot = sent.value
    for batch in batches:
        ah, ch = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        at = np.minimum(np.searchsorted(hot["ch"], ch), len(hot) - 1)
        found = (hot["ch"][at] == ch) & (hot["ah"][at] == ah)
        if not wanted:
            yield batch.filter(pa.array(~found))
            continue
        k, lo, more = (batch.column(i).to_numpy()[found] for i in (2, 3, 4))
        edge = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        row, a, b = _joined(np.cumsum(edge) - 1, lo, lo + more + 1)
        first = np.flatnonzero(edge)
        yield pa.RecordBatch.from_arrays([pa.array(k[first][row]), pa.array(a), pa.array((b - a - 1).astype(np.int32))], names=["k", "lo", "more"])


def hot_contexts(kinds: DataFrame) -> np.ndarray:
    """The most frequent contexts, at most ``MOST_HOT``, as (ah, ch) sorted by ch; of contexts that share a ch one is taken."""
    rows = kinds.filter(F.col("c") >= HOT).orderBy(F.desc("c"), "ch", "ah").limit(MOST_HOT).select("ah", "ch").toPandas()
    out = np.zeros(len(rows), [("ah", np.int64), ("ch", np.int64)])
    out["ah"], out["ch"] = rows["ah"], rows["ch"]
    out = out[np.argsort(out["ch"], kind="stable")]
    return out[np.unique(out["ch"], return_index=True)[1]]


def _contexts(batches, span: int):
    """The bytes of the contexts asked for: columns k, text, wanted (list of ah, lo, more, edge, kinds)."""
    for batch in batches:
        key = batch.column(0)
        body, offsets = text_bytes(batch.column(1))
        view = memoryview(np.ascontiguousarray(body))
        lists = batch.column(2)
        flat = lists.flatten()
        ah, lo, more, edge, kinds = (flat.field(i) for i in range(5))
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        start = offsets[row] + lo.to_numpy()
        end = start + more.to_numpy() + span
        for at in range(0, len(row), 5000):
            to = min(len(row), at + 5000)
            ctx = pa.array([bytes(view[a:b]) for a, b in zip(start[at:to].tolist(), end[at:to].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([ah.slice(at, to - at), key.take(pa.array(row[at:to])), *[x.slice(at, to - at) for x in (lo, more, edge)], ctx, kinds.slice(at, to - at)], names=["ah", "k", "lo", "more", "edge", "ctx", "kinds"])


def _asked(texts: DataFrame, wanted: DataFrame, n_wanted: int, span: int) -> DataFrame:
    """``ah, k, lo, more, edge, ctx, kinds``: the bytes of the contexts ``wanted (k, w)``.

    Texts are never shuffled: the list is dealt by key to slices of about ``MOST_BROADCAST_ENTRIES``, which are sent to all tasks one after
    another, and each slice reads the texts once; of several slices the contexts are written.
    """
    slices = max(1, -(-n_wanted // MOST_BROADCAST_ENTRIES))

    def one(part: DataFrame) -> DataFrame:
        grouped = part.groupBy("k").agg(F.collect_list("w").alias("ws"))
        found = texts.join(F.broadcast(grouped), "k").select("k", "text", "ws")
        return found.mapInArrow(tidy(lambda batches: _contexts(batches, span)), "ah long, k long, lo long, more int, edge boolean, ctx binary, kinds long")

    if slices == 1:
        return one(wanted)
    return cut_parts(texts.sparkSession, (one(wanted.filter(F.pmod("k", F.lit(slices)) == s)) for s in range(slices)))


def window_tokens(body: np.ndarray, starts: np.ndarray, span: int) -> list[np.ndarray]:
    roll, size = Rolling(body), span // PARTS
    return [roll(starts + k * size, starts + (k + 1) * size) for k in range(PARTS)]


def multikey_repeats(tokens: list[np.ndarray]) -> np.ndarray:
    """Which entries have an equal: sort by the first token; only ties are sorted by the next one."""
    n = len(tokens[0])
    live, group = np.arange(n), np.zeros(n, np.int64)
    for token in tokens:
        order = np.lexsort((token[live], group))
        t, g = token[live][order], group[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (g[1:] != g[:-1])]) if len(t) else np.zeros(0, bool)
        label = np.cumsum(new) - 1
        tied = np.bincount(label)[label] > 1 if len(label) else new
        live, group = live[order][tied], label[tied]
    out = np.zeros(n, bool)
    out[live] = True
    return out


def _windows(more: np.ndarray, sizes: np.ndarray):
    """Context of each window and its place in the joined contexts."""
    count = more + 1
    owner = np.repeat(np.arange(len(more)), count)
    first = np.cumsum(count) - count
    step = np.arange(int(count.sum())) - first[owner]
    return owner, step, (np.cumsum(sizes) - sizes)[owner] + step


def _runs(repeated: np.ndarray, owner: np.ndarray, step: np.ndarray):
    """Maximal runs of repeated windows within a context: (context, first, last)."""
    edge = np.concatenate([[True], (owner[1:] != owner[:-1]) | (repeated[1:] != repeated[:-1])]) if len(owner) else np.zeros(0, bool)
    first = np.flatnonzero(edge)
    last = np.concatenate([first[1:], [len(owner)]]) - 1 if len(first) else first
    kept = repeated[first]
    return owner[first[kept]], step[first[kept]], step[last[kept]]


def _bucket(batches, span: int):
    """Sort the windows of a bucket and give the runs of repeated ones, by context."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    ah = table.column("ah").to_numpy()
    order = np.argsort(ah, kind="stable")
    ah = ah[order]
    heads = np.concatenate([np.flatnonzero(np.concatenate([[True], ah[1:] != ah[:-1]])), [len(ah)]])
    more = table.column("more").to_numpy().astype(np.int64)[order]
    windows = np.concatenate([[0], np.cumsum(more + 1)])
    i = 0
    while i < len(heads) - 1:
        j = max(i + 1, int(np.searchsorted(windows[heads], windows[heads[i]] + 150_000)) - 1)
        pick = order[heads[i] : heads[j]]
        part = table.take(pa.array(pick)).combine_chunks()
        body, offsets = text_bytes(part.column("ctx").combine_chunks().cast(pa.binary()))
        owner, step, start = _windows(more[heads[i] : heads[j]], np.diff(offsets))
        # The leading token comes first, so only windows of one anchor are compared.
        repeated = multikey_repeats([ah[heads[i] : heads[j]][owner].view(np.uint64), *window_tokens(body, start, span)])
        c, a, b = _runs(repeated & part.column("edge").to_numpy()[owner], owner, step)
        lo = part.column("lo").to_numpy()[c]
        yield pa.RecordBatch.from_arrays([pa.array(part.column("k").to_numpy()[c]), pa.array(lo + a), pa.array((b - a).astype(np.int32))], names=["k", "lo", "more"])
        i = j


def _exploded(batches, span: int):
    """One row a window, for leading tokens with too many contexts for a bucket."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            body, offsets = text_bytes(part.column(5))
            more = part.column(3).to_numpy().astype(np.int64)
            owner, step, start = _windows(more, np.diff(offsets))
            tokens = window_tokens(body, start, span)
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(tokens[0] ^ mix(tokens[1])).view(np.int64)), pa.array(mix(tokens[2] ^ mix(tokens[3])).view(np.int64)), pa.array(part.column(1).to_numpy()[owner]), pa.array(part.column(2).to_numpy()[owner] + step), pa.array(part.column(4).to_numpy(zero_copy_only=False)[owner])],
                names=["a", "b", "k", "lo", "edge"],
            )


def _spans(batches, span: int):
    """Removed byte spans of each text: its repeated windows, widened to their bytes and joined."""
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten()
        lo, more = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
        owner, begins, ends = _joined(np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lo, lo + more + span)
        counts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]).astype(np.int32)
        spans = [pa.ListArray.from_arrays(pa.array(counts), pa.array(x)) for x in (begins, ends)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *spans], names=["k", "begins", "ends"])


def repeated_spans(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """``k, begins, ends``: the byte spans to remove, for each key of ``texts (k, text)`` that has any."""
    per_task = lambda f, *args: tidy(lambda batches: f(batches, *args))
    rows = cut(texts.mapInArrow(per_task(_anchor_rows, span), "ah long, ch long, k long, lo long, more int"))
    kinds = cut(rows.groupBy("ah", "ch").agg(F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in ("k", "lo", "more")]))
    tokens = cut(kinds.groupBy("ah").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("t"), F.min("c").alias("least")).filter("t > 1").drop("t"))
    shared = cut(kinds.join(tokens, "ah"))
    hot = hot_contexts(kinds)
    parts = []
    if len(hot):
        sent = texts.sparkSession.sparkContext.broadcast(hot)
        parts.append(rows.mapInArrow(per_task(_by_heat, sent, True), "k long, lo long, more int"))
        rows = rows.mapInArrow(per_task(_by_heat, sent, False), rows.schema)
    # Hot rows are gone from the left side, so a group of the join has fewer than ``HOT`` rows, or no place among the hot ones.
    parts.append(rows.join(shared.filter("c > 1").select("ah", "ch"), ["ah", "ch"], "left_semi").select("k", "lo", "more"))
    # Contexts to compare: those seen once whose token is not, and one of each kind that they may partly equal.
    wanted = cut(shared.filter("least = 1 AND kinds > 1").select("k", F.struct("ah", "lo", "more", (F.col("c") == 1).alias("edge"), "kinds").alias("w")))
    n_wanted = wanted.count()
    contexts = _asked(texts, wanted, n_wanted, span)
    usual, crowded = (contexts.filter(kept).drop("kinds") for kept in (F.col("kinds") <= MOST_IN_BUCKET, F.col("kinds") > MOST_IN_BUCKET))
    n_buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_wanted // ROWS_A_BUCKET))
    found = usual.repartitionByRange(n_buckets, "ah").mapInArrow(per_task(_bucket, span), "k long, lo long, more int")
    parts.append(found)
    if not wanted.filter(F.col("w.kinds") > MOST_IN_BUCKET).isEmpty():
        windows = cut(crowded.mapInArrow(per_task(_exploded, span), "a long, b long, k long, lo long, edge boolean"))
        twice = cut(windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("a", "b"))
        parts.append(windows.filter("edge").join(twice, ["a", "b"]).select("k", "lo", F.lit(0).alias("more")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return cut(every.groupBy("k").agg(F.collect_set(F.struct("lo", "more")).alias("s")).mapInArrow(per_task(_spans, span), "k long, begins array<long>, ends array<long>"))


def few_entries(spans: DataFrame) -> bool:
    """Whether all spans together, whose lists may have any length, are small enough to broadcast."""
    return (spans.agg(F.sum(F.size("begins") + 1)).first()[0] or 0) <= MOST_BROADCAST_ENTRIES


def _long_enough(part: np.ndarray, bounds: np.ndarray, begin: np.ndarray, end: np.ndarray, words: int) -> np.ndarray:
    """Which spans (places in ``part``) hold at least so many whole words, or ``SPAN`` bytes."""
    if not words:
        return np.ones(len(begin), bool)
    starts, ends, _ = word_bounds(part, bounds)
    return (np.searchsorted(ends, end, side="right") - np.searchsorted(starts, begin) >= words) | (end - begin >= SPAN)


def remove_repeats(df: DataFrame, as_text: bool = False, span: int = SPAN, least_words: int = 0, passages: bool = False) -> DataFrame:
    """All columns of ``df`` plus ``n_bytes``, ``n_removed``, ``n_spans`` long and ``kept`` binary (the remaining bytes).

    A byte is removed if a string of ``span`` bytes (a multiple of 4) that covers it also starts elsewhere, and its
    maximal run of such bytes holds at least ``least_words`` whole words or ``SPAN`` bytes. ``passages`` adds ``n_passages`` and
    ``passage_bytes`` long: the runs, and their bytes, that a span of ``PASSAGE_SPAN`` bytes and ``PASSAGE_WORDS``
    words would remove; nothing is removed for them. With ``as_text`` ``kept`` is a string, without the code points of which
    only a part remains.
    Null texts count as empty; texts under ``span`` bytes lose nothing. A repeated row is a second place of each of its
    strings, so both lose all that is longer. Texts of any length are read in overlapping pieces. Clashing columns are
    replaced; an empty table gives no rows. Texts are read three times and not shuffled while the lists of contexts
    and spans have up to ``MOST_BROADCAST_ENTRIES`` entries. Beyond that they are read once for each so many contexts, and only texts that
    lose a span meet their spans by shuffle.
    """
    small_batches(df.sparkSession)
    if span % PARTS:
        raise ValueError(f"span must be a multiple of {PARTS}")
    added = ["n_bytes", "n_removed", "n_spans", *["n_passages", "passage_bytes"] * passages]
    df = df.drop(*added, "kept", "__k", "begins", "ends", "__pb", "__pe")
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    texts = df.select(key.alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(texts, span)
    few = few_entries(spans)
    if passages:
        others = repeated_spans(texts, PASSAGE_SPAN)
        few = few and few_entries(others)
        spans = spans.join(others.select("k", F.col("begins").alias("__pb"), F.col("ends").alias("__pe")), "k", "full_outer")
    sized = df.withColumn("__k", key)
    if few:
        joined = sized.join(F.broadcast(spans), F.col("__k") == F.col("k"), "left").drop("__k", "k")
    else:
        some = among(spans.select("k"))
        met = sized.filter(some(F.col("__k"))).join(spans.hint("merge"), F.col("__k") == F.col("k"), "left").drop("__k", "k")
        joined = sized.filter(~some(F.col("__k"))).drop("__k").unionByName(met, allowMissingColumns=True).select(*met.columns)
    names = df.columns
    at_text = names.index("text")

    def gone_bytes(part, bounds, begin, end, words):
        """A mask of the bytes in spans that are long enough, and the number of these spans of each row."""
        n = len(bounds) - 1
        row = np.repeat(np.arange(n), np.nan_to_num(begin.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))
        a, b = begin.flatten().to_numpy() + bounds[row], end.flatten().to_numpy() + bounds[row]
        ok = _long_enough(part, bounds, a, b, words)
        step = np.zeros(len(part) + 1, np.int32)
        np.add.at(step, a[ok], 1)
        np.add.at(step, b[ok], -1)
        return np.cumsum(step[:-1]) > 0, np.bincount(row[ok], minlength=n)

    def run(batches):
        for batch in batches:
            body, offsets = text_bytes(batch.column(at_text))
            lists = batch.columns[len(names) :]
            for a, b in chunks(offsets):
                part, bounds = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                some = [x.slice(a, b - a) for x in lists]
                gone, n_spans = gone_bytes(part, bounds, *some[:2], least_words)
                n_gone = np.concatenate([[0], np.cumsum(gone)])
                kept = part[~gone]
                places = (bounds - n_gone[bounds]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(kept.tobytes())])
                if as_text:
                    binary = pa.array([x.decode("utf-8", "ignore") for x in binary.to_pylist()], pa.string())
                values = [np.diff(bounds), n_gone[bounds[1:]] - n_gone[bounds[:-1]], n_spans]
                if passages:
                    gone, n_passages = gone_bytes(part, bounds, *some[2:], PASSAGE_WORDS)
                    n_gone = np.concatenate([[0], np.cumsum(gone)])
                    values += [n_passages, n_gone[bounds[1:]] - n_gone[bounds[:-1]]]
                columns = [c.slice(a, b - a) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v.astype(np.int64)) for v in values], binary], names=[*names, *added, "kept"])

    schema = df.limit(0).withColumns({c: F.lit(None).cast("long") for c in added}).withColumn("kept", F.lit(None).cast("string" if as_text else "binary")).schema
    return joined.mapInArrow(tidy(run), schema)
