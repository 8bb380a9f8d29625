"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The words of each source are dealt by hash into blocks. A source's target is a number
of whole epochs over its blocks and a part of one more; every (epoch, block) is a draw.
The exact numbers of draws of all sources are split among the output shards by a tree:
each node hands a multivariate-hypergeometric share to its left half. A shard then takes
its share of each source as a disjoint range of the permuted draws and is shuffled locally.
There are at most ``MOST_BLOCKS`` blocks and a few draws of each, so the draws of any table fit a broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import running_before
from .textio import WORD, cut

BLOCK_WORDS, MOST_BLOCKS = 50_000, 1 << 16
#: The driver's small tables pass as Arrow: rows of Python objects would start a second daemon and its workers on every executor.
_SOURCES = pa.schema([("__s", pa.int32()), ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("nb", pa.int64()), ("whole", pa.int32()), ("rest", pa.int64())])
_ENDS = pa.schema([("__s", pa.int32()), ("ends", pa.list_(pa.int64()))])


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the sum of all sizes by weight; a target stops at ``most`` times its size and the excess is shared again."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def split_quotas(quotas: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Shards x sources: the draws of each source that each shard takes; columns add up to the quotas."""
    out = np.zeros((n_shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, have: np.ndarray):
        if hi - lo == 1 or not have.sum():
            out[lo] = have
            return
        mid = (lo + hi) // 2
        total = int(have.sum())
        n_left = total * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, n_left, method="marginals")
        node(lo, mid, left)
        node(mid, hi, have - left)

    node(0, n_shards, np.array(quotas, np.int64))
    return out


def source_targets(df: DataFrame, weights=(1, 2, 3), most: float = 3, size="size") -> list[tuple]:
    """(source, words, target) in code-point order, null last; one row a source comes to the driver."""
    rows = sorted(df.groupBy("source").agg(F.sum(size).alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in rows]
    targets = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    return [(r["source"], n, t) for r, n, t in zip(rows, sizes, targets, strict=True)]


def measured(df: DataFrame, seed: int = 23) -> DataFrame:
    """All columns of ``df`` plus ``size`` (words of the text) and the hash ``__h`` that places a row."""
    df = df.drop("size", "__h")
    return df.withColumn("size", word_count()).withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", F.col("text")))


def block_draws(sizes: DataFrame, n_shards: int, weights, most: float, seed: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Of ``sizes (source, size, __h)``: the table of sources, and the draws of each of their blocks.

    Sources: ``__s, source, source_size, target, nb`` (blocks). Draws: ``__s, __b, draws`` (array of epoch, shard, and for
    the one block that is drawn in part its ``room`` in words). Both have a bounded number of rows, but for many sources.
    """
    spark = sizes.sparkSession
    found = source_targets(sizes, weights, most)
    block_words = max(block_words, -(-sum(n for _, n, _ in found) // MOST_BLOCKS))
    table = []
    for i, (name, n, target) in enumerate(found):
        goal = round(target)
        whole = goal // n if n else 0
        table.append((i, name, n, float(target), max(1, -(-n // block_words)), int(whole), int(goal - whole * n)))
    sources = spark.createDataFrame(pa.Table.from_pylist([dict(zip(_SOURCES.names, row, strict=True)) for row in table], _SOURCES))
    blocks = cut(place(sizes, sources).groupBy("__s", "__b").agg(F.sum("size").alias("n"))).join(F.broadcast(sources.select("__s", "whole", "rest")), "__s")
    # The part of an epoch: whole blocks in permuted order while they fit, then the documents of the next one.
    order = Window.partitionBy("__s").orderBy(F.xxhash64(F.lit(seed + 1), "__s", "__b"), "__b")
    upto = blocks.withColumn("upto", F.sum("n").over(order))
    part = upto.filter(F.col("upto") - F.col("n") < F.col("rest")).select("__s", "__b", F.col("whole").alias("epoch"), F.when(F.col("upto") > F.col("rest"), F.col("rest") - F.col("upto") + F.col("n")).alias("room"))
    full = blocks.filter("whole > 0").select("__s", "__b", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"), F.lit(None).cast("long").alias("room"))
    permuted = Window.partitionBy("__s").orderBy(F.xxhash64(F.lit(seed + 2), "__s", "epoch", "__b"), "epoch", "__b")
    draws = cut(full.unionByName(part).withColumn("place", F.row_number().over(permuted) - 1))
    quotas = {r["__s"]: r["count"] for r in draws.groupBy("__s").count().collect()}
    tree = split_quotas([quotas.get(i, 0) for i in range(len(table))], n_shards, seed)
    ends = spark.createDataFrame(pa.Table.from_pylist([{"__s": i, "ends": np.cumsum(tree[:, i]).tolist()} for i in range(len(table))], _ENDS))
    dealt = draws.join(F.broadcast(ends), "__s").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
    return sources, cut(dealt.groupBy("__s", "__b").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "room"))).alias("draws")))


def place(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the number of their source and their block."""
    named = F.broadcast(sources.select("__s", F.col("source").alias("__source"), F.col("nb").alias("__nb")))
    return rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__b", F.pmod("__h", F.col("__nb"))).drop("__source", "__nb")


def words_before(rows: DataFrame) -> DataFrame:
    """``__u``: the words of the rows before each one in its source, in the order of ``__h``, then doc_id.

    Sizes are added up by ranges of ``__h``, so the block of a source that is cut is no single task; rows of one hash, copies of
    one document, are a window of their own, from the words of the hashes before.
    """
    upto = Window.partitionBy("__s", "__h").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cells = rows.groupBy("__s", "__h").agg(F.sum("size").alias("w"))
    before = running_before(cells, ["__s"], "__h", ["w"]).select("__s", "__h", F.col("w_before").alias("__before"))
    return rows.join(before, ["__s", "__h"]).withColumn("__u", F.col("__before") + F.sum("size").over(upto) - F.col("size")).drop("__before")


def take_words(rows: DataFrame, sizes: DataFrame | None = None, n_shards: int = 8, weights=(1, 2, 3), most: float = 3, seed: int = 23, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each row of ``rows`` (made by ``measured``) with what the mix takes of it.

    All columns plus ``source_size`` long, ``target`` double and ``takes`` (array of epoch int, shard int, words long), one
    row for each input row, rows that are equal included. A row is taken whole or not at all in an epoch, but for one
    document a source that is cut, and at most ceil(most) times; the taken words of a source are its rounded target exactly.
    ``sizes`` may hold the columns ``source, size, __h`` of the same rows where these are already written. Null texts have size
    0; null sources are one source, the last in order; rows without words are taken as often as their block is drawn.
    An empty table gives no rows. Nothing is shuffled but sizes by block, and the rows of one block of each source.
    """
    sizes = sizes if sizes is not None else cut(rows.select("source", "size", "__h"))
    sources, draws = block_draws(sizes, n_shards, weights, most, seed, block_words)
    rows = rows.drop("__s", "__b", "__u", "source_size", "target", "takes", "draws")
    placed = place(rows, sources).join(F.broadcast(draws), ["__s", "__b"], "left")
    is_cut = F.exists("draws", lambda d: d["room"].isNotNull())
    whole = lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.col("size").alias("words"))
    uncut = placed.filter(~F.coalesce(is_cut, F.lit(False))).withColumn("takes", F.coalesce(F.transform("draws", whole), F.expr("array()").cast("array<struct<epoch:int,shard:int,words:bigint>>")))
    some = words_before(placed.filter(is_cut))
    part = lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.when(d["room"].isNull(), F.col("size")).otherwise(F.least(F.col("size"), d["room"] - F.col("__u"))).alias("words"))
    some = some.withColumn("takes", F.transform(F.filter("draws", lambda d: d["room"].isNull() | (d["room"] > F.col("__u"))), part)).drop("__u")
    sized = F.broadcast(sources.select("__s", "source_size", "target"))
    return uncut.unionByName(some).join(sized, "__s").select(*[F.col(f"`{c}`") for c in rows.columns], "source_size", "target", "takes")


def mix_sources(df: DataFrame, n_shards: int = 8, weights=(1, 2, 3), most: float = 3, seed: int = 23, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: a row for each time that a row of ``df`` is taken.

    All columns of ``df`` plus ``size``, ``words`` (taken: all but at one cut document a source), ``epoch`` int,
    ``shard`` int, ``mix_key`` long (order within the shard) and ``source_size, target`` of its source. Texts are as in ``df``; take
    ``cut_text()`` for the text of the cut documents. Columns of the added names are replaced. See ``take_words`` for the rest.
    """
    df = df.drop("size", "words", "epoch", "shard", "mix_key", "source_size", "target", "takes", "__h")
    taken = take_words(measured(df, seed), None, n_shards, weights, most, seed, block_words)
    mix = taken.withColumn("__t", F.explode("takes")).withColumn("mix_key", F.xxhash64(F.lit(seed + 3), "__h", "__t.epoch"))
    return mix.select(*[F.col(f"`{c}`") for c in df.columns], "size", "__t.words", "__t.epoch", "__t.shard", "mix_key", "source_size", "target")


def in_shard_order(mix: DataFrame) -> DataFrame:
    """The rows of each shard together and shuffled locally: partitions in the order of the mix key, 64 ranges of it a shard."""
    return mix.repartition("shard", F.shiftrightunsigned("mix_key", 58)).sortWithinPartitions("shard", "mix_key")


def cut_text():
    """The text of a row of the mix: whole, or its first words joined by spaces where the document was cut."""
    return F.when(F.col("words") >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.lit(1), F.col("words")).cast("int")), " "))


def write_mix(mix: DataFrame, path: str) -> None:
    """Shards as ``path/shard=k/``, each in its own local order. Null texts stay null; an empty mix writes no shard."""
    in_shard_order(mix).write.partitionBy("shard").parquet(path)
