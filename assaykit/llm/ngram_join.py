"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two texts link when their sets of word shingles have a Jaccard similarity of at least
0.8. Tokens (64-bit hashes of shingles) have one order for all documents: those found
often while reading come last, the rest by hash. A linked pair shares at least
``SPARE`` + 1 tokens among the first n - ceil(0.8 n) + 1 + ``SPARE`` of each, so a document
may leave ``SPARE`` of its long inverted lists unmerged and still meet its partners in a
short one. The steps:

1. short lists are merged per document, counting occurrences, and partners that can still
   reach the overlap with the long lists set aside become candidates;
2. candidates are decided exactly: the tokens of one set are probed in the other by binary
   search;
3. documents that consist mostly of long lists (members of large groups of near copies, or texts with passages that
   many others quote) are first joined to the least document of their list; where a list still holds more than one
   component, its documents are searched once more among themselves, with the tokens frequent among them last, so that
   the passages they share no longer decide whom they meet;
4. only those that still consist of lists long among them meet in cells, each cell with its own inverted index,
   merged and probed in the same way, exactly.

Tables that grow with the documents are joined by sort and merge beyond ``FEW`` rows, whatever their size: Spark would send a table of a
few megabytes of ids, which holds millions of them, through the driver. Smaller ones go to all tasks and are written by few, so the many
steps cost little where there is little to do. Which texts a step reads again is told by four bytes a document.

Components alone need no second decision for a pair that is connected already. How many documents each one links
with is counted afterwards: links lie within components, so small components share cells and large ones
are cut into parts whose cells meet pairwise; a cell gives counts, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .textio import MOST_AMONG, among, chunks, cut, cut_few, held, met, mix, shingle_sets, short_hash, short_hashes, small_batches, text_bytes, tidy

WIDTH, SPARE, LONG = 5, 16, 64
MOST_FREQUENT = 1 << 18  # tokens put last in the order; the choice never changes the result
FREQUENT_WINDOW = 1_000_000
CELL = 600
SETS = 200  # whole sets that a task may take


def needed(a, b):
    """Least overlap of linked sets of sizes a and b: 100 i >= 80 (a + b - i)."""
    return -(-4 * (a + b) // 9)


def prefix_size(n):
    return np.minimum(n, n - -(-4 * n // 5) + 1 + SPARE)


def unread(n):
    """How many tokens of a set of n lie behind its prefix."""
    return n - prefix_size(n)


def _sets(batches, id_at: int = 0, text_at: int = 1):
    """(ids, sets) per chunk of texts."""
    for batch in batches:
        body, offsets = text_bytes(batch.column(text_at))
        for a, b in chunks(offsets):
            yield batch.column(id_at).slice(a, b - a), shingle_sets(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WIDTH)


def _sizes(batches):
    for ids, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.fromiter(map(len, sets), np.int64, len(sets)))], names=["doc_id", "n_shingles"])


def _frequent(batches):
    """Tokens that come three times or more within a window of a million: lower bounds of their frequency."""
    held, size = [], 0

    def flush():
        nonlocal size
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        size = 0
        often = n >= 3
        return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(n[often])], names=["h", "c"])

    for _, sets in _sets(batches, 0, 0):
        held.extend(sets)
        size += sum(map(len, sets))
        if size >= FREQUENT_WINDOW:
            yield flush()
    if held:
        yield flush()


def frequent_tokens(texts: DataFrame) -> np.ndarray:
    """The most frequent tokens of all texts, at most ``MOST_FREQUENT`` (two megabytes), sorted."""
    found = texts.select("text").mapInArrow(tidy(_frequent), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= LONG)
    return _most_frequent(found)


def _most_frequent(counted: DataFrame) -> np.ndarray:
    """About the ``MOST_FREQUENT`` tokens of ``h, c`` with the highest counts, or all if they are fewer, sorted.

    The driver gets their bound from how often each count comes, and then only them; a sort for them would bring it so many of each task.
    """
    counted, left, taken = cut(counted), MOST_FREQUENT, F.lit(True)
    if counted.count() > MOST_FREQUENT:
        for c, n in sorted(map(tuple, counted.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
            if n > left:  # of equal counts a share, told by the token, which is a hash
                taken = (F.col("c") > c) | ((F.col("c") == c) & (F.pmod("h", F.lit(1 << 20)) < left * (1 << 20) // n))
                break
            left -= n
    return np.sort(counted.filter(taken).select("h").toArrow().column("h").to_numpy().view(np.uint64))


def _prefixes(sets: list[np.ndarray], last: np.ndarray) -> pa.ListArray:
    """The prefix of each set, in whose order the tokens of ``last`` come last."""
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    late = held(last, flat)
    out, start = [np.zeros(0, np.uint64)], 0
    for s in sets:
        w = late[start : start + len(s)]
        start += len(s)
        ordered = np.concatenate([s[~w], s[w]]) if w.any() else s
        out.append(ordered[: int(prefix_size(len(s)))] if len(s) else ordered)
    sizes = np.cumsum([len(p) for p in out]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(out).view(np.int64)))


def _described(texts: DataFrame, frequent) -> DataFrame:
    """doc_id, n, a 128-bit digest of the set, and its prefix."""

    def run(batches):
        for ids, sets in _sets(batches):
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            d1 = [s.sum(dtype=np.uint64) for s in sets]
            d2 = [np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else np.uint64(0) for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), _prefixes(sets, frequent.value)], names=["doc_id", "n", "d1", "d2", "prefix"])

    return texts.mapInArrow(tidy(run), "doc_id long, n long, d1 long, d2 long, prefix array<long>")


def _token_sets(texts: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """id and its whole sorted set for the ids given, at most ``most``, and in rare cases for others; equal ids are taken once. Texts are not shuffled.

    One function picks the rows and reads their sets, so a task has one Python worker.
    """
    known = short_hashes(ids.select("id"), most)

    def picked(batches):
        for batch in batches:
            yield batch if known is None else batch.filter(pa.array(held(known.value, batch.column(2).to_numpy())))

    def run(batches):
        for ids, sets in _sets(picked(batches)):
            sizes = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "tokens"])

    rows = texts.select("doc_id", "text", short_hash(F.col("doc_id")).alias("h"))
    return cut_few(rows.mapInArrow(tidy(run), "id long, tokens array<long>").dropDuplicates(["id"]), most, SETS)


def _merge_short(batches):
    """Per document: its short lists merged with counts; partners that can reach the overlap remain."""
    for batch in batches:
        x, n, long_ = (batch.column(k).to_numpy() for k in range(3))
        lists = batch.column(3)
        members = lists.flatten()
        y, m, k = (np.asarray(members.field(i)) for i in range(3))
        row = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((y, row))
        row, y, m, k = row[order], y[order], m[order], k[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (y[1:] != y[:-1])])) if len(row) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([new, [len(row)]]))
        row, y, m, k = row[new], y[new], m[new], k[new]
        a = n[row]
        near = 5 * np.minimum(a, m) >= 4 * np.maximum(a, m)
        least = needed(a, m) - np.maximum(unread(a), unread(m)) - np.minimum(long_[row], k)
        kept = near & (count >= least)
        yield pa.RecordBatch.from_arrays([pa.array(x[row[kept]]), pa.array(y[kept]), pa.array(count[kept])], names=["x", "y", "o"])


def _probe(batches):
    """Pairs whose overlap is large enough, by binary search of the smaller set in the larger."""
    for batch in batches:
        s, t = batch.column(2), batch.column(3)
        kept = []
        for i in range(batch.num_rows):
            a, b = (np.asarray(c[i].values).view(np.uint64) for c in (s, t))
            if len(a) > len(b):
                a, b = b, a
            hits = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
            kept.append(len(a) > 0 and 180 * hits >= 80 * (len(a) + len(b)))
        keep = pa.array(kept, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])


def verified(texts: DataFrame, pairs: DataFrame, most: int, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (x, y) that link, of at most ``most``; by ``sets`` (id, tokens), where those are at hand, without reading texts."""
    pairs = cut_few(pairs.select("x", "y").distinct(), most)
    n = pairs.count()
    if sets is None:
        sets = _token_sets(texts, pairs.select(F.explode(F.array("x", "y")).alias("id")), 2 * n)
    left = sets.select(F.col("id").alias("x"), F.col("tokens").alias("s")).join(met(pairs, n), "x")
    both = left.join(sets.select(F.col("id").alias("y"), F.col("tokens").alias("t")).hint("merge"), "y")
    return cut_few(both.select("x", "y", "s", "t").mapInArrow(tidy(_probe), "x long, y long"), n, SETS)


class DivideSkip:
    """T-occurrence search in an inverted index of some sets, held in memory."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        self.tokens, first = np.unique(flat[order], return_index=True)
        self.ends = np.concatenate([first, [len(flat)]])
        self.owners = owner[order]
        self.sizes = sizes

    def search(self, query: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Places of the sets with Jaccard of 0.8 or more, among those allowed."""
        n = len(query)
        allowed = allowed & (5 * np.minimum(n, self.sizes) >= 4 * np.maximum(n, self.sizes))
        if not n or not allowed.any() or not len(self.tokens):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        found = at[self.tokens[at] == query]
        length = self.ends[found + 1] - self.ends[found]
        least = -(-4 * n // 5)  # no partner needs less
        if len(found) < least:
            return np.zeros(0, np.int64)
        by_length = np.argsort(length, kind="stable")
        # The longest lists are set aside, as many as the published rule gives: T / (mu log M + 1).
        aside = min(least - 1, int(least / (0.0085 * np.log(max(2, length.max())) + 1)))
        short, long_ = found[by_length[: len(found) - aside]], found[by_length[len(found) - aside :]]
        sizes = self.ends[short + 1] - self.ends[short]
        merged = np.repeat(self.ends[short] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        counts = np.bincount(self.owners[merged], minlength=len(self.sets))
        need = needed(n, self.sizes)
        candidates = np.flatnonzero(allowed & (counts >= np.maximum(1, need - len(long_))))
        probes = np.sort(self.tokens[long_])
        hits = []
        for c in candidates:
            s = self.sets[c]
            more = int((s[np.minimum(np.searchsorted(s, probes), len(s) - 1)] == probes).sum()) if len(probes) else 0
            hits.append(counts[c] + more >= need[c])
        return candidates[np.array(hits, bool)] if len(candidates) else candidates


def _cell(pdf):
    """Links between the two parts of a cell that join different components."""
    import pandas as pd

    pdf = pdf.sort_values("id").reset_index(drop=True)
    sets = [np.asarray(t, np.int64).view(np.uint64) for t in pdf["tokens"]]
    index = DivideSkip(sets)
    ids, part = pdf["id"].to_numpy(), pdf["part"].to_numpy()
    group = pd.factorize(pdf["cluster"])[0]
    same = bool(pdf["same"].iloc[0])
    out = []
    for q in range(len(ids)):
        allowed = (group != group[q]) & (np.arange(len(ids)) < q) & (same | (part != part[q]))
        for c in index.search(sets[q], allowed):
            if group[c] != group[q]:
                out.append((ids[q], ids[c]))
                group[group == group[q]] = group[c]
    return pd.DataFrame(out, columns=["x", "y"]).astype("int64")


def _counted_cell(pdf):
    """Of each set of a cell the rows of the sets that it links with, over the pairs that the cell decides."""
    import pandas as pd

    pdf = pdf.sort_values("id").reset_index(drop=True)
    sets = [np.asarray(t, np.int64).view(np.uint64) for t in pdf["tokens"]]
    index = DivideSkip(sets)
    rows, part, same = pdf["rows"].to_numpy(), pdf["part"].to_numpy(), bool(pdf["same"].iloc[0])
    out, place = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for q in range(len(sets)):
        hits = index.search(sets[q], (place < q) & (same | (part != part[q])))
        out[q] += rows[hits].sum()
        out[hits] += rows[q]
    kept = out > 0
    return pd.DataFrame({"id": pdf["id"].to_numpy()[kept], "links": out[kept]})


def in_cells(members: DataFrame) -> DataFrame:
    """``members (id, label)`` dealt to cells (g, i, j), in which each pair of one label meets once; ``part`` and ``same`` (i = j) say where.

    Labels of up to ``CELL`` members share cells with others and are sent once; the members of a larger one are sent once for each of
    its parts. So what is sent grows with the square of a label's members over ``CELL``, not with that of all members.
    """
    total = members.count()
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    small = F.col("m") <= CELL
    group = F.when(small, -1 - F.pmod(F.xxhash64("label"), F.lit(max(1, -(-total // CELL))))).otherwise(F.col("label"))
    parts = F.when(small, 1).otherwise(F.ceil(F.col("m") / CELL)).cast("int")
    placed = members.join(met(sizes, total), "label").withColumn("g", group).withColumn("p", parts).withColumn("part", F.pmod(F.xxhash64("id"), F.col("p")).cast("int"))
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    cells = sent.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).withColumn("same", F.col("i") == F.col("j"))
    return cells.drop("label", "m", "p", "other")


def linked_rows(texts: DataFrame, known: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``id, links``: of each class that links with others the rows of those, from the components (``node, label``, at most ``most`` rows) of all classes.

    A component of up to ``CELL`` classes lies in one cell with others; a larger one has a cell for each pair of its parts, so its
    sets are sent as often as it has parts. The work is that of the pairs in a component, all of which are decided.
    """
    counts = known.groupBy(F.col("class_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    members = cut_few(counts.join(met(labels.select(F.col("node").alias("id"), "label"), most), "id"), most)
    cells = _token_sets(texts, members.select("id"), most).join(in_cells(members).hint("merge"), "id")
    return cells.groupBy("g", "i", "j").applyInPandas(_counted_cell, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def _one_a_class(described: DataFrame, classes: DataFrame, known: DataFrame, named: int) -> DataFrame:
    """``doc_id, n, prefix`` of the least document of each set, and in rare cases of a copy of it, which is then one more node.

    Prefixes are the bulk of what is described, so which rows are taken is told by four bytes a class. Only rows whose id comes more than once
    are compared by their sets, as are all where the classes are too many for that.
    """
    exact = lambda d: d.join(classes.select(F.col("class_id").alias("doc_id"), "n", "d1", "d2").hint("merge"), ["doc_id", "n", "d1", "d2"], "left_semi").select("doc_id", "n", "prefix").dropDuplicates(["doc_id", "n"])
    filled = described.filter("n > 0")
    if classes.count() > MOST_AMONG:
        return exact(filled)
    taken = filled.filter(among(classes.select("class_id"), named)(F.col("doc_id")))
    twice = cut_few(known.groupBy("doc_id").count().filter("count > 1").select("doc_id"), named)
    if not (n_twice := twice.count()):
        return taken.select("doc_id", "n", "prefix")
    is_twice = among(twice, n_twice)(F.col("doc_id"))
    return taken.filter(~is_twice).select("doc_id", "n", "prefix").unionByName(exact(taken.filter(is_twice)))


def searched(kinds: DataFrame, named: int) -> tuple[DataFrame, DataFrame, int]:
    """Of ``kinds (doc_id, n, prefix)``: the candidates ``x, y, o`` that short lists give, the long lists ``h, x, n`` of heavy documents, and how many documents are in long ones."""
    postings = kinds.select(F.col("doc_id").alias("x"), "n", F.explode("prefix").alias("h"))
    shared = cut(postings.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("c > 1"))
    # Long lists: light documents leave them aside, heavy ones keep them.
    longs = cut_few(shared.filter(F.col("c") > LONG).groupBy("x", "n").agg(F.count(F.lit(1)).alias("k")), named)
    with_long = longs.count()
    heavy = longs.filter(F.col("k") > F.least(F.lit(SPARE), F.ceil(F.col("n") * 4 / 5) - 1)).select("x")
    short = shared.filter(F.col("c") <= LONG).join(met(longs.select("x", "k"), with_long), "x", "left").select("h", F.struct("x", "n", F.coalesce("k", F.lit(0)).alias("k")).alias("m"))
    lists = short.groupBy("h").agg(F.sort_array(F.collect_list("m")).alias("m"))  # at most LONG members
    before = lists.select(F.posexplode("m").alias("i", "d"), "m").filter("i > 0").select("d.x", "d.n", "d.k", F.slice("m", F.lit(1), F.col("i")).alias("ys"))
    merged = before.groupBy("x", "n", "k").agg(F.flatten(F.collect_list("ys")).alias("ys")).mapInArrow(tidy(_merge_short), "x long, y long, o long")
    candidates = cut(merged)
    kept_long = cut(shared.filter(F.col("c") > LONG).join(met(heavy, with_long), "x", "left_semi").select("h", "x", "n"))
    return candidates, kept_long, with_long


def _stars(kept_long: DataFrame, least: DataFrame, lists: int) -> DataFrame:
    """``x, y, o``: each document of a long list with the least of it, and how many lists say so."""
    return kept_long.join(met(least, lists), "h").filter("x <> y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("o"))


def _labelled(df: DataFrame, column: str, labels: DataFrame, most: int, name: str) -> DataFrame:
    """``df`` with ``name``, the label (of ``node, label``, at most ``most`` rows) of a column, or its own value."""
    own = labels.select(F.col("node").alias(column), F.col("label").alias("__l"))
    return df.join(met(own, most), column, "left").withColumn(name, F.coalesce("__l", column)).drop("__l")


def _apart(pairs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The pairs ``x, y`` whose components differ."""
    return _labelled(_labelled(pairs, "x", labels, most, "lx"), "y", labels, most, "ly").filter("lx <> ly").drop("lx", "ly")


def _mixed(placed: DataFrame, rows: int, lists: int) -> DataFrame:
    """``h, x, cluster`` of the long lists that hold more than one component; at most so many rows and lists."""
    mixed = placed.groupBy("h").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b")).filter("a <> b").select("h")
    return cut_few(placed.select("h", "x", "cluster").join(met(mixed, lists), "h", "left_semi"), rows)


def _prefixed(batches, frequent):
    for batch in batches:
        lists = batch.column(1)
        flat, ends = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sets = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), _prefixes(sets, frequent.value)], names=["doc_id", "n", "prefix"])


def _searched_again(texts: DataFrame, undecided: DataFrame, found: DataFrame, ends: int, most: int) -> DataFrame:
    """Links ``x, y`` between different components of ``found`` among the documents of ``undecided (h, x, cluster)``, at most ``most``.

    Which tokens are frequent is counted exactly among these documents, so a passage that many of them quote comes last in the order of each.
    Both of a linked pair stand in a list that holds their two components, so both are here.
    """
    ids = cut_few(undecided.select(F.col("x").alias("id")).distinct(), most)
    n_ids = ids.count()
    sets = _token_sets(texts, ids, n_ids)
    if n_ids > MOST_AMONG:
        sets = cut(sets.join(ids.hint("merge"), "id", "left_semi"))
    often = sets.select(F.explode("tokens").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > LONG)
    frequent = undecided.sparkSession.sparkContext.broadcast(_most_frequent(often))
    kinds = sets.select("id", "tokens").mapInArrow(tidy(lambda batches: _prefixed(batches, frequent)), "doc_id long, n long, prefix array<long>")
    candidates, kept_long, _ = searched(kinds, n_ids)
    in_long = kept_long.count()
    least = cut_few(kept_long.groupBy("h").agg(F.min("x").alias("y")), in_long)
    lists = least.count()
    stars = _stars(kept_long, least, lists).groupBy("x").agg(F.max_by("y", F.struct("o", -F.col("y"))).alias("y"))
    pairs = _apart(candidates.select("x", "y").unionByName(stars.select("x", "y")), found, ends)
    more = verified(texts, pairs, candidates.count() + n_ids, sets)
    linked = more.count()
    # Labels of labels: components that the new links join are one.
    joined = components(_labelled(_labelled(more, "x", found, ends, "a"), "y", found, ends, "b").select("a", "b"), "a", "b", most=linked)
    rest = _mixed(_labelled(_labelled(kept_long, "x", found, ends, "own"), "own", joined, 2 * linked, "cluster"), in_long, lists)
    if left := rest.count():
        # Documents that no chain of shared lists connects need not meet.
        heads = rest.groupBy("h").agg(F.min("x").alias("y"))
        groups = components(rest.join(met(heads, lists), "h").filter("x <> y").select("x", "y"), most=left)
        left_over = cut_few(rest.select(F.col("x").alias("id"), "cluster").distinct().join(met(groups.select(F.col("node").alias("id"), "label"), n_ids), "id"), n_ids)
        met_in_cells = sets.join(in_cells(left_over).hint("merge"), "id")
        more = more.unionByName(cut(met_in_cells.groupBy("g", "i", "j").applyInPandas(_cell, "x long, y long")))
    return more


def jaccard_components(df: DataFrame, links: bool = False) -> DataFrame:
    """Per row ``doc_id, n_shingles, class_id, component_id``, with ``links`` also ``n_links`` long: how many other rows it links with.

    ``class_id`` is the least doc_id with the same set of shingles, ``component_id`` the least doc_id
    reachable by links. Null and empty texts and texts without words have size 0, link with nothing and are their
    own class and component; fewer than five words are one shingle. Rows with the same doc_id are one node whose
    rows all carry its component. Rows whose doc_id is null are kept with their size, but have no name to link by: their
    class and component are null. Equal sets are decided once, so groups of
    copies cost one set. An empty table gives no rows.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = rows.filter(F.col("doc_id").isNotNull())
    frequent = df.sparkSession.sparkContext.broadcast(frequent_tokens(texts))
    described = cut(_described(texts, frequent))
    named = described.count()
    classes = cut_few(described.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id")), named)
    known = cut_few(described.select("doc_id", "n", "d1", "d2").join(classes.hint("merge"), ["n", "d1", "d2"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")), named)
    candidates, kept_long, with_long = searched(_one_a_class(described, classes, known, named), named)
    in_long = kept_long.count()
    least = cut_few(kept_long.groupBy("h").agg(F.min("x").alias("y")), in_long)
    lists_kept = least.count()
    first = cut_few(candidates.unionByName(_stars(kept_long, least, lists_kept)).groupBy("x").agg(F.max_by("y", F.struct("o", -F.col("y"))).alias("y")), named)
    decided = first.count()
    direct = verified(texts, first, decided)
    linked = direct.count()
    found = components(direct, most=linked)
    rest = _apart(candidates, found, 2 * linked)
    more = verified(texts, rest.join(met(first, decided), ["x", "y"], "left_anti"), candidates.count())
    undecided = _mixed(_labelled(kept_long, "x", found, 2 * linked, "cluster"), in_long, lists_kept)
    if undecided.count():
        more = more.unionByName(_searched_again(texts, undecided, found, 2 * linked, with_long))
    extra = more.count()
    final = components(direct.unionByName(more), most=linked + extra) if extra else found
    ends = 2 * (linked + extra)
    out = known.join(met(final.select(F.col("node").alias("class_id"), "label"), ends), "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("label", "class_id").alias("component_id"))
    if links:
        others = cut_few(linked_rows(texts, known.filter("n > 0"), final, min(ends, named)), min(ends, named))
        copies = known.filter("n > 0").groupBy("class_id").agg((F.count(F.lit(1)) - 1).alias("copies"))
        out = out.join(copies.hint("merge"), "class_id", "left").join(met(others.withColumnRenamed("id", "class_id"), ends), "class_id", "left")
        n_links = F.when(F.col("n_shingles") == 0, 0).otherwise(F.coalesce("copies", F.lit(0)) + F.coalesce("links", F.lit(0)))
        out = out.select("doc_id", "n_shingles", "class_id", "component_id", n_links.alias("n_links"))
    nameless = rows.filter(F.col("doc_id").isNull()).mapInArrow(tidy(_sizes), "doc_id long, n_shingles long")
    return out.unionByName(nameless, allowMissingColumns=True)
