"""Removal of repeated passages by automata of the phrases that recur.

A window is ``SPAN`` consecutive words. Its seed is the leftmost smallest hash among its phrases of ``PHRASE`` words, so equal
windows have equal seeds. Windows in a row that share a seed are a context. Contexts whose seed occurs once can't repeat.

1. Seeds are counted; contexts of recurring seeds are grouped into kinds (equal contexts), with their number and smallest id.
2. Recurring passages are confirmed. If all contexts of a seed are equal, the whole context is a passage; else one context of each
   kind gives its windows, which are counted over all kinds. Passages come with the smallest id of a document that holds them.
3. Passages are dealt by seed to shards of bounded size, each of which compiles an Aho-Corasick automaton.
4. All documents are streamed again. Their contexts of seeds with passages go to the shard of the seed, equal contexts of a chunk
   as one row with all its places, and the automaton finds every occurrence of its passages in them.
5. A window found goes if its passage is held by a document with a smaller id, or if it starts earlier in the same document.

An automaton reads one letter a word (a byte of the word's hash), which keeps its nodes small; a hit counts only where the
64-bit hash of the words agrees with that of the passage. Shards that many contexts go to are copied, contexts dealt among the
copies; a seed with very many passages is cut into automata that each see all its contexts.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_dedup import few_entries, sliding_least
from .textio import chunks, cut, mix, powers, small_batches, span_hashes, text_bytes, tidy, word_bounds

SPAN, PHRASE = 20, 6
CHUNK, PIECE_BYTES, PIECE_WORDS = 1_000_000, 500_000, 1 << 21
LETTERS_A_SHARD = 1_000_000  # about 50 MB of automaton
CONTEXTS_A_COPY = 50_000  # and twice the mean, before a shard is copied
MOST_SEEDS = 3_000_000  # known to every task, 9 bytes each; beyond it contexts are joined with them by shuffle
MOST_KINDS = 3_000_000  # likewise, 26 bytes each
_POSITION_BITS = 22
_LAST = 2**63 - 1
_U = np.uint64
_PHRASE_STEP = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, made in pieces of bounded bytes."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE_BYTES, side="right")))
        a = starts[i]
        out[i:j] = span_hashes(body[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


class Contexts:
    """The contexts of a chunk of rows: row, seed ``ah``, hash ``ch``, first and last window ``lo``, ``hi`` (places in the chunk)."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, span: int = SPAN):
        self.span = span
        starts, ends, self.first = word_bounds(body, offsets)
        self.words = word_hashes(body, starts, ends)
        parts = [self._part(at) for at in range(0, max(1, len(self.words) - span + 1), PIECE_WORDS)]
        self.row, self.ah, self.ch, self.lo, self.hi = (np.concatenate(x) for x in zip(*parts, strict=True))

    def _part(self, at: int):
        words = self.words[at : at + PIECE_WORDS + self.span - 1]
        n = len(words)
        if n < self.span:
            return [np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64)]
        phrases = np.zeros(n - PHRASE + 1, np.uint64)
        for k in range(PHRASE):
            phrases += words[k : n - PHRASE + 1 + k] * _PHRASE_STEP[k]
        phrases = mix(phrases)
        keys = (phrases >> _U(_POSITION_BITS) << _U(_POSITION_BITS)) | np.arange(len(phrases), dtype=np.uint64)
        seed = (sliding_least(keys, self.span - PHRASE + 1) & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)
        window = np.arange(len(seed))
        row = np.searchsorted(self.first, window + at, side="right") - 1
        inside = np.flatnonzero(window + at + self.span <= self.first[row + 1])
        seed, row = seed[inside], row[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        lo, hi = inside[begin] + at, inside[np.append(begin[1:], len(inside)) - 1] + at if len(begin) else begin
        return row[begin], phrases[seed[begin]], self.hashes(lo, hi - lo + self.span), lo, hi

    def hashes(self, lo: np.ndarray, length) -> np.ndarray:
        """Hashes of runs of words; a context of one window has the hash of the window."""
        if not hasattr(self, "total"):
            up, self.down = powers(len(self.words) + 1)
            self.total = np.zeros(len(self.words) + 1, np.uint64)
            np.cumsum(self.words * up[: len(self.words)], out=self.total[1:])
        return mix((self.total[lo + length] - self.total[lo]) * self.down[lo] + _U(0x9E3779B9) * np.asarray(length).astype(np.uint64))

    def keep(self, kept: np.ndarray) -> None:
        self.row, self.ah, self.ch, self.lo, self.hi = (x[kept] for x in (self.row, self.ah, self.ch, self.lo, self.hi))

    def places(self) -> np.ndarray:
        """The first window of each context, counted in its row."""
        return self.lo - self.first[self.row]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context, step in the context and hash of each window."""
        count = self.hi - self.lo + 1
        owner = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return owner, step, self.hashes(self.lo[owner] + step, self.span)

    def letters(self, pick: np.ndarray) -> pa.Array:
        """The letters of some contexts."""
        size = self.hi[pick] - self.lo[pick] + self.span
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.repeat(self.lo[pick] - at[:-1], size) + np.arange(at[-1])
        data = (self.words[flat] & _U(255)).astype(np.uint8)
        return pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _chunks(batches, span: int):
    """Contexts with the keys and ids of their rows; batches of k, d, text."""
    for batch in batches:
        k, d = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        body, offsets = text_bytes(batch.column(2))
        for a, b in chunks(offsets, CHUNK):
            got = Contexts(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], span)
            if len(got.lo):
                yield got, k[a:b], d[a:b]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _found(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted array, and whether it is there."""
    at = np.minimum(np.searchsorted(among, values), max(0, len(among) - 1))
    return at, (among[at] == values) if len(among) else np.zeros(len(values), bool)


def _seed_counts(batches, span: int):
    for got, _, _ in _chunks(batches, span):
        ah, n = np.unique(got.ah, return_counts=True)
        yield pa.RecordBatch.from_arrays([_signed(ah), pa.array(n)], names=["ah", "n"])


def _place(k: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(k.view(np.uint64) ^ mix(lo.astype(np.uint64)))


def _occurrences(batches, span: int, seeds):
    """A row for each context of a seed in ``seeds`` (of any seed, if None)."""
    for got, k, d in _chunks(batches, span):
        if seeds is not None:
            got.keep(_found(got.ah, seeds.value)[1])
        place = _place(k[got.row], got.places())
        yield pa.RecordBatch.from_arrays([_signed(got.ah), _signed(got.ch), pa.array(d[got.row]), _signed(place)], names=["ah", "ch", "d", "place"])


def _list(values: pa.Array, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values)


def _examples(batches, span: int, kinds):
    """Letters and window hashes of the one context that stands for its kind; of every context, if ``kinds`` is None."""
    for got, k, _ in _chunks(batches, span):
        place = _place(k[got.row], got.places())
        if kinds is not None:
            at, there = _found(got.ch, kinds.value["ch"])
            got.keep(there & (kinds.value["place"][at] == place))
            place = _place(k[got.row], got.places())
        hs = _list(_signed(got.windows()[2]), got.hi - got.lo + 1)
        columns = [_signed(got.ah), _signed(got.ch), _signed(place), got.letters(np.arange(len(got.lo))), hs]
        batch = pa.RecordBatch.from_arrays(columns, names=["ah", "ch", "place", "letters", "hs"])
        if kinds is None:
            yield batch
        else:
            at, _ = _found(got.ch, kinds.value["ch"])
            for name in ("c", "d", "mixed"):
                values = kinds.value[name][at]
                batch = batch.append_column(name, pa.array(values if name == "mixed" else values.astype(np.int64)))
            yield from _passages([batch], span)


def _passages(batches, span: int):
    """Of a kind whose seed has no other, the whole context; of the others each window: h, ah, mixed, c, d, letters."""
    for batch in batches:
        c, d, mixed = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "d", "mixed"))
        mixed = mixed.astype(bool)
        names = ["h", "ah", "mixed", "c", "d", "letters"]
        whole = pa.array(~mixed)
        columns = [batch.column(x).filter(whole) for x in ("ch", "ah", "mixed", "c", "d", "letters")]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        part = batch.filter(pa.array(mixed))
        hs, letters = part.column("hs"), part.column("letters")
        size = np.diff(hs.offsets.to_numpy())
        owner = np.repeat(np.arange(len(size)), size)
        body, offsets = text_bytes(letters)
        start = offsets[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        data = body[(start[:, None] + np.arange(span))].tobytes() if len(owner) else b""
        fixed = np.arange(0, (len(owner) + 1) * span, span, dtype=np.int32)
        windows = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(fixed.tobytes()), pa.py_buffer(data)])
        rows = [hs.flatten(), part.column("ah").take(pa.array(owner)), pa.array(np.ones(len(owner), bool))]
        yield pa.RecordBatch.from_arrays([*rows, pa.array(c[mixed][owner]), pa.array(d[mixed][owner]), windows], names=names)


def _streamed(batches, span: int, anchors):
    """Contexts of seeds with passages, equal ones of a chunk as one row: letters, hashes, and key, id, place and ``again`` of each.

    ``hs`` holds the hash of the context alone where a seed has one kind, else those of its windows. Bit w of ``again`` is set if window w
    also starts earlier in its row. Without ``anchors`` all contexts come, with both.
    """
    for got, k, d in _chunks(batches, span):
        mixed = None
        if anchors is not None:
            seeds, kind = anchors.value
            at, there = _found(got.ah, seeds)
            got.keep(there)
            mixed = kind[at[there]]
        if not len(got.lo):
            continue
        owner, step, h = got.windows()
        row = got.row[owner]
        order = np.lexsort((np.arange(len(h)), h, row))
        twice = np.zeros(len(h), bool)
        twice[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
        count = got.hi - got.lo + 1
        first = np.cumsum(count) - count
        again = np.add.reduceat(twice.astype(np.int32) << step.astype(np.int32), first)
        order = np.lexsort((got.ah, got.ch))
        new = np.ones(len(order), bool)
        new[1:] = (got.ch[order[1:]] != got.ch[order[:-1]]) | (got.ah[order[1:]] != got.ah[order[:-1]])
        begin = np.flatnonzero(new)
        one, size = order[begin], np.diff(np.append(begin, len(order)))
        wide = np.ones(len(one), bool) if mixed is None else mixed[one]
        n_hashes = np.where(wide, count[one], 1)
        at = np.repeat(first[one] - (np.cumsum(n_hashes) - n_hashes), n_hashes) + np.arange(n_hashes.sum())
        hashes = np.where(np.repeat(wide, n_hashes), h[at], np.repeat(got.ch[one], n_hashes))
        each = [_signed(k[got.row[order]]), pa.array(d[got.row[order]]), pa.array(got.places()[order].astype(np.int32)), pa.array(again[order].astype(np.int32))]
        columns = [_signed(got.ah[one]), _signed(got.ch[one]), got.letters(one), _list(_signed(hashes), n_hashes), *[_list(x, size) for x in each]]
        yield pa.RecordBatch.from_arrays(columns, names=["ah", "ch", "letters", "hs", "ks", "ds", "los", "again"])


class Automaton:
    """An Aho-Corasick automaton of passages; a hit counts if the hash of its words is that of a passage of its length."""

    def __init__(self, h: np.ndarray, first: np.ndarray, letters: list[bytes], span: int):
        order = np.argsort(h, kind="stable")
        self.h, self.first, self.span = h[order], first[order], span
        self.length = np.array([len(x) for x in letters], np.int64)[order]
        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for x in letters:
            self.search.add_word(x.decode("latin-1"), len(x))
        self.search.make_automaton()

    def firsts(self, letters: pa.Array, hs: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """For each window of each context (laid out one behind the other, with offsets) the smallest id that holds it."""
        body, offsets = text_bytes(letters)
        size = np.diff(offsets)
        count = size - self.span + 1
        base = np.concatenate([[0], np.cumsum(count)])
        out = np.full(int(base[-1]), _LAST, np.int64)
        # One text of all contexts, parted by a letter that no word has.
        shift = np.arange(len(size))
        text = np.full(len(body) + len(size), 256, np.uint16)
        text[np.arange(len(body)) + np.repeat(shift, size)] = body
        hits = np.array(list(self.search.iter(text.astype("<u2").tobytes().decode("utf-16-le"))), np.int64).reshape(-1, 2)
        end, length = hits[:, 0], hits[:, 1]
        begin = end - length + 1
        context = np.searchsorted(offsets[:-1] + shift, begin, side="right") - 1
        step = begin - (offsets[:-1] + shift)[context]
        known = np.diff(hs.offsets.to_numpy())
        single = known[context] == 1
        fits = np.where(single, (step == 0) & (length == size[context]), (length == self.span) & (step < known[context]))
        context, step, length = context[fits], step[fits], length[fits]
        flat, start = hs.flatten().to_numpy(), hs.offsets.to_numpy()[:-1] - hs.offsets.to_numpy()[0]
        value = flat[start[context] + np.where(known[context] == 1, 0, step)]
        at, there = _found(value, self.h)
        there &= self.length[at] == length if len(self.h) else False
        context, step, n, first = context[there], step[there], length[there] - self.span + 1, self.first[at[there]]
        slot = np.repeat(base[context] + step - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[slot] = np.repeat(first, n)
        return out, base


def _removed(part: pa.RecordBatch, automaton: Automaton):
    """``k, lo, mask``: of each place of each context the windows to remove."""
    first, base = automaton.firsts(part.column("letters"), part.column("hs"))
    ks, ds, los, again = (part.column(x) for x in ("ks", "ds", "los", "again"))
    size = np.diff(ks.offsets.to_numpy())
    owner = np.repeat(np.arange(len(size)), size)
    d, bits = ds.flatten().to_numpy(), again.flatten().to_numpy()
    mask = np.zeros(len(owner), np.int32)
    count = np.diff(base)[owner]
    for w in range(int(count.max(initial=0))):
        has = np.flatnonzero(count > w)
        held = first[base[owner[has]] + w]
        gone = (held < d[has]) | ((held != _LAST) & (bits[has] >> w & 1 == 1))
        mask[has] |= gone.astype(np.int32) << w
    kept = pa.array(mask != 0)
    return pa.RecordBatch.from_arrays([ks.flatten().filter(kept), los.flatten().filter(kept), pa.array(mask).filter(kept)], names=["k", "lo", "mask"])


def _located(batches, span: int):
    """Rows sorted by (shard, cut, copy, tag): the passages of an automaton, then the contexts that it reads."""
    at, held, automaton = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
        edges = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            part, key = batch.slice(a, b - a), tuple(keys[:3, a])
            if key != at:
                at, held, automaton = key, [], None
            if keys[3, a] == 0:
                held.append((part.column("h").to_numpy(), part.column("first").to_numpy(), part.column("letters").to_pylist()))
                continue
            if automaton is None and held:
                h, first, letters = zip(*held, strict=True)
                automaton, held = Automaton(np.concatenate(h), np.concatenate(first), sum(letters, []), span), []
            if automaton is not None:
                yield _removed(part, automaton)


def _spans(batches, span: int):
    """The removed words of each row: its removed windows, widened to their words and joined, as ranges."""
    for batch in batches:
        for k, windows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            lo, mask = (windows.values.field(i).to_numpy() for i in (0, 1))
            width = int(mask.max()).bit_length()
            start = np.unique(np.concatenate([lo[mask >> w & 1 == 1] + w for w in range(width)]))
            edge = np.flatnonzero(np.diff(start) > span)
            begin, end = start[np.append(0, edge + 1)], start[np.append(edge, len(start) - 1)] + span
            columns = [pa.array([x], t) for x, t in ((k, pa.int64()), (begin.tolist(), pa.list_(pa.int64())), (end.tolist(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "begins", "ends"])


def _sorted_arrays(rows: DataFrame, key: str) -> dict:
    """Columns of a bounded table as arrays in the order of an unsigned key."""
    table = rows.toArrow()
    keys = table.column(key).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    out = {key: keys[order]}
    for c in table.column_names:
        if c != key:
            x = table.column(c).to_numpy()
            out[c] = (x.view(np.uint64) if c == "place" else x)[order]
    return out


def repeated_words(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """``k, begins, ends``: ranges of the words to remove, for each key of ``texts (k, d, text)`` that has any."""
    spark = texts.sparkSession
    task = lambda f, *args: tidy(lambda batches: f(batches, span, *args))
    send = spark.sparkContext.broadcast
    seeds = cut(texts.mapInArrow(task(_seed_counts), "ah long, n long").groupBy("ah").agg(F.sum("n").alias("n")).filter("n > 1").select("ah"))
    few_seeds = seeds.count() <= MOST_SEEDS
    sent = send(_sorted_arrays(seeds, "ah")["ah"]) if few_seeds else None
    places = texts.mapInArrow(task(_occurrences, sent), "ah long, ch long, d long, place long")
    places = places if few_seeds else places.join(seeds, "ah", "left_semi")
    kinds = cut(places.groupBy("ah", "ch").agg(F.count(F.lit(1)).alias("c"), F.min("d").alias("d"), F.min("place").alias("place")))
    many = kinds.groupBy("ah").agg((F.count(F.lit(1)) > 1).alias("mixed"))
    kinds = cut(kinds.join(many, "ah"))
    if few_seeds:
        sent.destroy()
    few_kinds = kinds.count() <= MOST_KINDS
    fields = "ah long, ch long, place long, letters binary, hs array<long>"
    passage = "h long, ah long, mixed boolean, c long, d long, letters binary"
    if few_kinds:
        # Of the number of contexts of a kind only matters whether there are more than one.
        short = kinds.select("ch", "place", "d", F.least("c", F.lit(2)).cast("byte").alias("c"), "mixed")
        sent = send(_sorted_arrays(short, "ch"))
        rows = texts.mapInArrow(task(_examples, sent), passage)
    else:
        rows = texts.mapInArrow(task(_examples, None), fields).join(kinds, ["ah", "ch", "place"])
        rows = rows.dropDuplicates(["ah", "ch"]).mapInArrow(task(_passages), passage)
    counted = rows.groupBy("h", "ah").agg(F.sum("c").alias("c"), F.min("d").alias("first"), F.max("mixed").alias("mixed"), F.first("letters").alias("letters"))
    passages = cut(counted.filter("c > 1").select("h", "ah", "first", "mixed", "letters"))
    if few_kinds:
        sent.destroy()
    n_letters = passages.agg(F.coalesce(F.sum(F.octet_length("letters")), F.lit(0))).first()[0]
    anchors = cut(passages.groupBy("ah").agg(F.max("mixed").alias("mixed")))
    n_shards = max(1, -(-n_letters // LETTERS_A_SHARD))
    shard = F.pmod(F.xxhash64("ah"), F.lit(n_shards)).cast("int")
    few_anchors = anchors.count() <= MOST_SEEDS
    known = _sorted_arrays(anchors, "ah") if few_anchors else None
    fields = "ah long, ch long, letters binary, hs array<long>, ks array<long>, ds array<long>, los array<int>, again array<int>"
    contexts = texts.mapInArrow(task(_streamed, send((known["ah"], known["mixed"].astype(bool))) if few_anchors else None), fields)
    if not few_anchors:
        contexts = contexts.join(anchors, "ah").withColumn("hs", F.when(F.col("mixed"), F.col("hs")).otherwise(F.array("ch"))).drop("mixed")
    # How a shard is cut (more letters than one automaton should hold) and copied (more contexts than one task should read).
    letters = passages.groupBy(shard.alias("shard")).agg(F.sum(F.octet_length("letters")).alias("letters"))
    loads = kinds.join(anchors.select("ah"), "ah", "left_semi").groupBy(shard.alias("shard")).agg(F.sum("c").alias("load"))
    loads = cut(loads.join(letters, "shard"))
    mean = max(CONTEXTS_A_COPY, 2 * (loads.agg(F.avg("load")).first()[0] or 0))
    loads = loads.select("shard", F.ceil(F.col("letters") / (4 * LETTERS_A_SHARD)).cast("int").alias("cuts"), F.ceil(F.col("load") / mean).cast("int").alias("copies"))
    loads = cut(loads)
    small = F.broadcast(loads) if n_shards <= MOST_SEEDS else loads
    n_tasks = loads.agg(F.coalesce(F.sum(F.col("cuts") * F.col("copies")), F.lit(1))).first()[0]
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = passages.withColumn("shard", shard).join(small, "shard").withColumn("cut", F.pmod("h", "cuts").cast("int")).withColumn("copy", upto("copies"))
    left = left.select("shard", "cut", "copy", F.lit(0).alias("tag"), "h", "first", "letters")
    dealt = F.pmod(F.xxhash64(F.element_at("ks", 1), F.element_at("los", 1)), F.col("copies")).cast("int")
    right = contexts.withColumn("shard", shard).join(small, "shard").withColumn("copy", dealt).withColumn("cut", upto("cuts"))
    right = right.select("shard", "cut", "copy", F.lit(1).alias("tag"), "letters", "hs", "ks", "ds", "los", "again")
    both = left.unionByName(right, allowMissingColumns=True)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_tasks)
    sorted_ = both.repartition(n_parts, "shard", "cut", "copy").sortWithinPartitions("shard", "cut", "copy", "tag")
    gone = sorted_.mapInArrow(task(_located), "k long, lo int, mask int")
    return cut(gone.groupBy("k").agg(F.collect_set(F.struct("lo", "mask")).alias("s")).mapInArrow(task(_spans), "k long, begins array<long>, ends array<long>"))


def remove_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """All columns of ``df`` plus ``n_words``, ``n_removed`` long and ``kept`` string (the remaining words, joined by one space).

    A word goes if a window of ``span`` words (``PHRASE`` to 30) that covers it also starts earlier: in a document with a smaller id, or
    earlier in its own. Null and empty texts have no words. A null id counts as larger than every other. Rows that share an id are
    not earlier than each other, so copies of one row keep the same words. Clashing columns are replaced; an empty table gives no
    rows. Documents are read five times and not shuffled while the ranges to remove are few enough to broadcast; a document is
    in memory as a whole, with some ten times its bytes.
    """
    small_batches(df.sparkSession)
    added = ["n_words", "n_removed", "kept"]
    df = df.drop(*added, "__k", "__s", "begins", "ends")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    texts = df.select(key.alias("k"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("d"), text.alias("text"))
    spans = repeated_words(texts, span).withColumnRenamed("k", "__s")
    sent = F.broadcast(spans) if few_entries(spans) else spans
    joined = df.withColumn("__k", key).join(sent, F.col("__k") == F.col("__s"), "left").drop("__k", "__s")
    names = df.columns
    at_text = names.index(text_col)

    def run(batches):
        for batch in batches:
            body, offsets = text_bytes(batch.column(at_text))
            lists = batch.columns[len(names) :]
            for a, b in chunks(offsets, CHUNK):
                part, bounds = body[offsets[a] : offsets[b]].copy(), offsets[a : b + 1] - offsets[a]
                starts, ends, first = word_bounds(part, bounds)
                begin, end = (x.slice(a, b - a) for x in lists)
                row = np.repeat(np.arange(b - a), np.nan_to_num(begin.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))
                step = np.zeros(len(starts) + 1, np.int32)
                np.add.at(step, begin.flatten().to_numpy() + first[row], 1)
                np.add.at(step, end.flatten().to_numpy() + first[row], -1)
                kept = np.cumsum(step[:-1]) == 0
                n_kept = np.concatenate([[0], np.cumsum(kept)])[first]
                # A kept word is followed by the byte after it, made a space, if its row keeps another one later.
                place = np.flatnonzero(kept)
                owner = np.searchsorted(first, place, side="right") - 1
                inner = np.ones(len(place), bool)
                inner[-1:] = False
                inner[:-1] = owner[1:] == owner[:-1]
                edge = np.zeros(len(part) + 2, np.int32)
                edge[starts[place]] += 1
                np.add.at(edge, ends[place] + inner, -1)
                part[ends[place[inner]]] = 32
                held = np.cumsum(edge[: len(part)]) > 0
                size = np.concatenate([[0], np.cumsum(held)])[bounds].astype(np.int32)
                text = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(size.tobytes()), pa.py_buffer(part[held].tobytes())])
                counts = [np.diff(first), np.diff(first) - np.diff(n_kept)]
                columns = [c.slice(a, b - a) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x.astype(np.int64)) for x in counts], text], names=[*names, *added])

    schema = df.limit(0).withColumns({"n_words": F.lit(None).cast("long"), "n_removed": F.lit(None).cast("long"), "kept": F.lit(None).cast("string")}).schema
    return joined.mapInArrow(tidy(run), schema)
