"""Sentence tables, BM25 search, text containment and roll-ups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrowtext import chunks, cut, shingle_sets, small_batches, span_hashes, text_bytes, tidy
from ..functions.scalar import normalised, single_spaced, squeezed
from .scan import scan_search

SHINGLE, GRAM = 5, 12
MOST_BROADCAST_KEYS = 1_000_000


def _sentences(text: F.Column, least: int) -> F.Column:
    parts = F.split(F.regexp_replace(single_spaced(text), "([.!?]) ([A-Z0-9\"'(])", "$1\n$2"), "\n")
    return F.filter(parts, lambda p: F.length(p) >= least)


def page_sentences(docs: DataFrame, key: str, text: str, least: int = 32, most: int = 900) -> DataFrame:
    """Sentences of a text within length bounds, the first of those equal but for case, with their place among those of the least length.

    White space, line ends too, counts as one space; a sentence ends at ``.``, ``!`` or ``?`` before a space and an
    upper-case letter, a digit, a quote or a parenthesis, so numbers and abbreviations before small letters stay whole.
    Wiki headings and HTML entities are left as they are.
    """
    s = docs.select(key, F.posexplode(_sentences(F.col(text), least)).alias("place", "sentence")).filter(F.length("sentence") <= most)
    return s.groupBy(key, F.lower("sentence").alias("folded")).agg(F.min(F.struct("place", "sentence")).alias("first")).select(key, "first.sentence", "first.place")


def page_lists(docs: DataFrame, key: str, title: str, text: str, least: int = 32, most: int = 900) -> DataFrame:
    """``key, title, s``: the sentences of ``page_sentences`` as one array of (place, text) a row, made where the text is read; a key must be its own."""
    small_batches(docs.sparkSession)
    known = docs.select(key, F.col(title).alias("title"), _sentences(F.col(text), least).alias("s"))
    known = known.withColumn("folded", F.transform("s", F.lower)).withColumn("size", F.transform("s", F.length))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                some = batch.slice(at, 50)
                out = []
                for s, folded, size in zip(*(some.column(c).to_pylist() for c in ("s", "folded", "size")), strict=True):
                    first = {}
                    for i, f in enumerate(folded or ()):
                        if size[i] <= most:
                            first.setdefault(f, i)
                    out.append([{"place": i, "text": s[i]} for i in first.values()])
                kind = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.string())]))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(out, kind)], names=[key, "title", "s"])

    return known.mapInArrow(tidy(run), f"`{key}` {dict(docs.dtypes)[key]}, title string, s array<struct<place: int, text: string>>")


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int) -> DataFrame:
    """The k best documents of each query by BM25, asked once: the texts are read where they are, and no index is written (see ``index`` for one)."""
    return scan_search(docs, queries, query_key, query_text, {text: 1.0}, k, key, empty=False)


def _grams(m: int, keys=None):
    """Per row (b, h): the hashes of its shingles of m words, those among the sorted keys if there are any."""

    def run(batches):
        for batch in batches:
            body, offsets = text_bytes(batch.column(1))
            for a, z in chunks(offsets):
                part, at = body[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                b = batch.column(0).slice(a, z - a)
                sets = shingle_sets(part, at, m)
                h = np.concatenate(sets).view(np.int64)
                row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                if keys is not None:
                    kept = np.isin(h, keys.value)
                    h, row = h[kept], row[kept]
                yield pa.RecordBatch.from_arrays([b.take(pa.array(row)), pa.array(h)], names=["b", "h"])

    return tidy(run)


def _byte_grams(n: int, keys=None):
    """Per row (b, h): the distinct hashes of its runs of n bytes, those among the sorted keys if there are any."""

    def run(batches):
        for batch in batches:
            body, offsets = text_bytes(batch.column(1))
            for a, z in chunks(offsets):
                part, at = body[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                count = np.maximum(0, np.diff(at) - n + 1)
                row = np.repeat(np.arange(z - a), count)
                start = np.arange(len(row)) - (np.cumsum(count) - count)[row] + at[row]
                h = span_hashes(part, start, start + n).view(np.int64) if len(row) else np.zeros(0, np.int64)
                if keys is not None:
                    kept = np.isin(h, keys.value)
                    h, row = h[kept], row[kept]
                order = np.lexsort((h, row))
                first = np.ones(len(order), bool)
                first[1:] = (h[order[1:]] != h[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
                row, h = row[order[first]], h[order[first]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).take(pa.array(row)), pa.array(h)], names=["b", "h"])

    return tidy(run)


def _held(small: DataFrame, big: DataFrame) -> DataFrame:
    """(s, b) where the text u of b contains the text t of s, both squeezed and not empty.

    All words of t but the first and last are whole words of u in the same order, so the first ``SHINGLE`` of
    them, or as many as there are, are one key. Texts of up to three words have one such word or none, which many texts may hold:
    their first ``GRAM`` bytes, or all if there are fewer, are the key among the runs of as many bytes of u. Keys of
    either kind are equi-joins.
    """
    longest = big.agg(F.max(F.length("u"))).first()[0]
    fits = small.filter(F.length("t") <= F.lit(longest or 0)).withColumn("w", F.split("t", " ")).withColumn("m", F.when(F.size("w") <= 3, -F.least(F.octet_length("t"), F.lit(GRAM))).otherwise(F.least(F.size("w") - 2, F.lit(SHINGLE))))
    sizes = {r["m"]: r["count"] for r in fits.groupBy("m").count().collect()}  # at most GRAM + SHINGLE rows
    found = small.join(big, F.lit(False)).select("s", "b")
    for m in sorted(sizes):
        grams = _grams if m > 0 else _byte_grams
        # Bytes cut from a text may end within a character; they are compared as bytes.
        inner = F.array_join(F.slice("w", 2, m), " ") if m > 0 else F.substring(F.col("t").cast("binary"), 1, -m)
        inner = fits.filter(F.col("m") == m).select("s", inner)
        keys = cut(inner.mapInArrow(grams(abs(m)), f"b {dict(small.dtypes)['s']}, h long").withColumnRenamed("b", "s"))
        known = None
        if sizes[m] <= MOST_BROADCAST_KEYS:
            known = small.sparkSession.sparkContext.broadcast(np.sort(keys.select("h").distinct().toPandas()["h"].to_numpy(np.int64)))
        found = found.unionByName(big.select("b", "u").mapInArrow(grams(abs(m), known), f"b {dict(big.dtypes)['b']}, h long").join(keys, "h").select("s", "b"))
    return cut(found.distinct()).join(small, "s").join(big, "b").filter(F.col("u").contains(F.col("t"))).select("s", "b")


def text_containment(docs: DataFrame, refs: DataFrame, key: str, text: str, ref_key: str, ref_text: str) -> DataFrame:
    """(ref_key, key) where either whole text contains the other, in lower case with single spaces.

    Empty and null texts match nothing; rows without a key are left out.
    """
    side = lambda d, k, t: d.filter(F.col(k).isNotNull()).select(F.col(k).alias("k"), squeezed(F.col(t)).alias("x")).filter("x <> ''")
    small_batches(docs.sparkSession)
    d, r = cut(side(docs, key, text)), cut(side(refs, ref_key, ref_text))
    inside = _held(r.toDF("s", "t"), d.toDF("b", "u")).toDF(ref_key, key)
    around = _held(d.toDF("s", "t"), r.toDF("b", "u")).toDF(key, ref_key)
    return inside.unionByName(around).distinct()


def source_matches(docs: DataFrame, refs: DataFrame, key: str, title: str, text: str, ref_key: str, ref_title: str, ref_text: str) -> DataFrame:
    """(ref_key, key) where the normalised titles are equal and either whole text contains the other, in lower case with single spaces.

    Empty and null titles and texts match nothing.
    """
    side = lambda d, k, h, t: d.filter(F.col(k).isNotNull()).select(F.col(k), normalised(F.col(h)).alias("__h"), squeezed(F.col(t)).alias(f"__{k}")).filter(f"__h <> '' AND `__{k}` <> ''")
    met = side(refs, ref_key, ref_title, ref_text).join(side(docs, key, title, text), "__h")
    one, other = F.col(f"__{ref_key}"), F.col(f"__{key}")
    return met.filter(one.contains(other) | other.contains(one)).select(ref_key, key).distinct()


def line_matches(docs: DataFrame, refs: DataFrame, key: str, text: str, ref_key: str, ref_text: str) -> DataFrame:
    """How many documents hold a reference, or are held by it, wherever its lines are broken."""
    return text_containment(docs, refs, key, text, ref_key, ref_text).groupBy(ref_key).agg(F.count_distinct(key).alias("docs"))


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each group in an order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
