"""The prefix trie of conversations, by a skeleton of splitter paths.

A conversation is a path: the digests of its turns, 16 bytes each, one behind the other, so that byte order is the order
of sequences and a byte prefix is a prefix of turns. Sampled splitters range-partition all (path, conv_id). A node whose
members lie in more than one shard is a prefix of a splitter between them; all such prefixes are the skeleton, a trie whose
size is bounded by the sample. It is broadcast. Each shard finishes all its other nodes from its sorted paths alone and
gives one partial aggregate for each skeleton node that it touches; the partials are reduced by node, and the skeleton's own
sums run up its few paths. The ids that end at a skeleton node are hashed in order as a stream of chunks.
"""

from __future__ import annotations

import bisect
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textio import cut

DIGEST = 16
TURNS_A_SHARD = 200_000
SAMPLES_A_SHARD = 8
SAMPLE_BYTES = 32_000_000  # of all sampled paths; also bounds the skeleton
MOST_SPLITTER_BYTES = 1 << 16  # longer paths are no splitters
_NONE = -(2**63)
_ROW = (
    "kind int, shard int, skel long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends string"
)
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in _ROW.split(", ")]
NODE, PARTIAL, ENDS = 0, 1, 2


def _turns(df: DataFrame) -> DataFrame:
    """``conv_id, base, t``: turn, digest and text bytes of each turn; null conv_ids have no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.col("turn")
    one = F.struct(turn.isNotNull().alias("known"), turn.alias("turn"), digest.alias("h"), F.octet_length(text).alias("b"))
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).filter("conv_id IS NOT NULL")


def _paths(turns: str) -> list:
    joined = F.array_join(F.transform(turns, lambda t: F.hex(t["h"])), "")
    return [F.unhex(joined).alias("path"), F.transform(turns, lambda t: t["b"]).alias("sizes")]


def conversation_paths(df: DataFrame) -> DataFrame:
    """``conv_id, path, sizes`` of the conversations as they are: turns in order, null first, ties by the digest of (role, text)."""
    ordered = _turns(df).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return ordered.select("conv_id", *_paths("ts"))


def rebuilt_paths(df: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """``conv_id, path, sizes`` of rebuilt conversations: the first h turns of conversation c - c % family, then c's own after its first h.

    h is crc32(decimal c) % most. One shuffle, by family; a family's first turns are found by a window over its few conversations.
    The digests of one conversation's turns (24 bytes a turn) are in one task together, as its text is in one path.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    turns = _turns(df).withColumn("base", base).repartition("base")
    ordered = turns.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    own_head = F.when(F.col("conv_id") == F.col("base"), F.slice("ts", 1, most - 1))
    head = F.first(own_head, ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = ordered.withColumn("head", F.coalesce(head, F.slice("ts", 1, 0))).withColumn("h", h)
    tail = F.slice(F.col("ts"), F.col("h") + 1, F.size("ts"))
    return rows.withColumn("ts", F.concat(F.slice(F.col("head"), F.lit(1), F.col("h")), tail)).select("conv_id", *_paths("ts"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    return len(os.path.commonprefix([a, b])) // DIGEST


class Skeleton:
    """Splitters in order, and the trie of their prefixes: ids in preorder, from the root 0."""

    def __init__(self, sample: list[tuple[bytes, int, list[int]]], n_shards: int):
        self.keys: list[tuple[bytes, int]] = []
        self.ids: list[list[int]] = []
        self.depth, self.parent, self.size = [0], [-1], [0]
        sample = sorted(sample, key=lambda s: s[:2])
        for i in sorted({len(sample) * k // n_shards for k in range(1, n_shards)} - {0}):
            if i >= len(sample):
                continue
            path, conv, sizes = sample[i]
            shared = _common(sample[i - 1][0], path)
            if sample[i - 1][0] != path:  # the shortest prefix that lies between the two
                path, conv = path[: (shared + 1) * DIGEST], _NONE
            if not self.keys or self.keys[-1] < (path, conv):
                self._add(path, conv, sizes)

    def _add(self, path: bytes, conv: int, sizes: list[int]) -> None:
        ids = self.ids[-1][: _common(self.keys[-1][0], path) + 1] if self.keys else [0]
        for d in range(len(ids), len(path) // DIGEST + 1):
            self.depth.append(d)
            self.parent.append(ids[-1])
            self.size.append(sizes[d - 1])
            ids.append(len(self.depth) - 1)
        self.keys.append((path, conv))
        self.ids.append(ids)

    def shard(self, path: bytes, conv: int) -> int:
        return bisect.bisect_right(self.keys, (path, conv))

    def near(self, shard: int) -> list[tuple[bytes, list[int]]]:
        """The splitters at both ends of a shard, with the ids of their prefixes; any other splitter shares no more with its paths."""
        return [(self.keys[k][0], self.ids[k]) for k in (shard - 1, shard) if 0 <= k < len(self.keys)] or [(b"", [0])]


def _dealt(batches, sent):
    skeleton = sent.value
    for batch in batches:
        shards = [skeleton.shard(p, c) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *batch.columns], names=["shard", "conv_id", "path", "sizes"])


def shard_nodes(shard: int, convs: list[int], paths: list[bytes], sizes: list, near: list[tuple[bytes, list[int]]]) -> list[tuple]:
    """Rows of the nodes of one shard, whose (path, conv_id) are sorted: finished nodes, and partials and ends of skeleton nodes."""
    depth, parent, skel, size, first, ends = [0], [-1], [0], [0], [0], [0]
    stack, before = [0], b""
    for i, path in enumerate(paths):
        if path != before:
            del stack[_common(before, path) + 1 :]
            shared, ids = max(((_common(path, s), ids) for s, ids in near), key=lambda x: x[0])
            for d in range(len(stack), len(path) // DIGEST + 1):
                parent.append(stack[-1])
                stack.append(len(depth))
                depth.append(d)
                skel.append(ids[d] if d <= shared else -1)
                size.append(sizes[i][d - 1])
                first.append(i)
                ends.append(0)
            before = path
        ends[stack[-1]] += 1
    n_nodes = len(depth)
    n, children, leaves, saved = list(ends), [0] * n_nodes, [0] * n_nodes, [0] * n_nodes
    least = [convs[first[k]] if ends[k] else None for k in range(n_nodes)]
    for k in range(n_nodes - 1, -1, -1):
        if skel[k] >= 0:
            continue
        leaves[k] = leaves[k] or 1
        saved[k] += (n[k] - 1) * size[k]
        up = parent[k]
        n[up] += n[k]
        children[up] += 1
        leaves[up] += leaves[k]
        saved[up] += saved[k]
        least[up] = least[k] if least[up] is None else min(least[up], least[k])
    rows = []
    for k in range(n_nodes):
        own = ",".join(map(str, convs[first[k] : first[k] + ends[k]]))
        if skel[k] >= 0:
            rows.append((PARTIAL, shard, skel[k], least[k], depth[k], None, n[k], children[k], leaves[k], saved[k], None))
            if own:
                rows.append((ENDS, shard, skel[k], None, None, None, None, None, None, None, own))
        else:
            up = parent[k]
            by = (None, least[up]) if skel[up] < 0 else (skel[up], None)
            rows.append((NODE, shard, by[0], least[k], depth[k], by[1], n[k], children[k], leaves[k], saved[k], hashlib.sha256(own.encode()).hexdigest()))
    return rows


def _shards(batches, sent):
    """Rows come sorted by (shard, path, conv_id); a shard is held until its last row."""
    skeleton = sent.value
    held, at = ([], [], []), None

    def flush():
        rows = shard_nodes(at, *held, skeleton.near(at)) if held[0] else []
        for k in range(0, len(rows), 10_000):
            part = zip(*rows[k : k + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, _TYPES, strict=True)], names=_NAMES)

    for batch in batches:
        for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != at:
                yield from flush()
                held, at = ([], [], []), shard
            for x, v in zip(held, row, strict=True):
                x.append(v)
    yield from flush()


def _hashed(batches):
    """``skel, sha`` of the ends of each node, whose chunks come in order; a chunk at a time is in memory."""
    at, digest = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], names=["skel", "sha"])
    for batch in batches:
        for skel, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if skel != at:
                if digest is not None:
                    yield out()
                at, digest = skel, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if digest is not None:
        yield out()


def _sampled(paths: DataFrame, n_rows: int, n_bytes: int, n_shards: int) -> list[tuple]:
    share = min(1.0, SAMPLES_A_SHARD * n_shards / n_rows, SAMPLE_BYTES / max(1, n_bytes))
    picked = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    rows = paths.filter(picked & (F.octet_length("path") <= MOST_SPLITTER_BYTES)).select("path", "conv_id", "sizes").collect()
    return [(bytes(r["path"]), r["conv_id"], r["sizes"]) for r in rows]


def _rolled_up(spark: SparkSession, skeleton: Skeleton, partials: DataFrame) -> DataFrame:
    """The skeleton's nodes with all their sums; its ids are in preorder, so sums run up in one pass over its bounded arrays."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    got = {r["skel"]: r for r in partials.groupBy("skel").agg(F.min("conv_id").alias("conv_id"), *sums).collect()}
    count = len(skeleton.depth)
    n, children, leaves, saved, least = np.zeros((5, count), np.int64)
    least[:] = np.iinfo(np.int64).max
    for k, r in got.items():
        n[k], children[k], leaves[k], saved[k] = r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]
        least[k] = least[k] if r["conv_id"] is None else r["conv_id"]
    for k in range(count - 1, -1, -1):
        leaves[k] = leaves[k] or 1
        saved[k] += (n[k] - 1) * skeleton.size[k]
        up = skeleton.parent[k]
        if up >= 0:
            n[up] += n[k]
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
            least[up] = min(least[up], least[k])
    up = [None if p < 0 else int(least[p]) for p in skeleton.parent]
    columns = [range(count), least.tolist(), skeleton.depth, up, n.tolist(), children.tolist(), leaves.tolist(), saved.tolist()]
    schema = "skel long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    return spark.createDataFrame(list(zip(*columns, strict=True)), schema)


def trie_nodes(paths: DataFrame) -> DataFrame:
    """One row for each distinct prefix of ``paths (conv_id, path, sizes)``, the empty one included.

    ``conv_id`` smallest member; ``depth``; ``parent_conv_id`` the parent's smallest member (null for the root); ``n_convs``
    members; ``n_children``; ``n_leaves`` nodes without children in the subtree; ``saved_tokens`` summed over the subtree, each
    node's (n_convs - 1) times the bytes of its last text; ``ends_sha256`` of the ids that end here, ascending, comma-joined.
    An empty table gives no rows. A repeated conv_id is a member of its own each time. Paths of any length are sorted, but only
    those of up to ``MOST_SPLITTER_BYTES`` are splitters. A shard (about ``TURNS_A_SHARD`` turns) is in one task's memory.
    """
    spark = paths.sparkSession
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    paths = cut(paths.select("conv_id", "path", "sizes"))
    n_rows, n_bytes = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    if not n_rows:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in names))
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(n_bytes // DIGEST + n_rows) // TURNS_A_SHARD))
    skeleton = Skeleton(_sampled(paths, n_rows, n_bytes, n_shards), n_shards)
    sent = spark.sparkContext.broadcast(skeleton)
    dealt = paths.mapInArrow(lambda batches: _dealt(batches, sent), "shard int, conv_id long, path binary, sizes array<int>")
    sharded = dealt.repartitionById(len(skeleton.keys) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    rows = cut(sharded.mapInArrow(lambda batches: _shards(batches, sent), _ROW))
    upper = cut(_rolled_up(spark, skeleton, rows.filter(F.col("kind") == PARTIAL)))
    chunks = rows.filter(F.col("kind") == ENDS).select("skel", "ends", "shard").repartition("skel").sortWithinPartitions("skel", "shard")
    hashes = chunks.select("skel", "ends").mapInArrow(_hashed, "skel long, sha string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    above = upper.join(hashes, "skel", "left").withColumn("ends_sha256", F.coalesce("sha", empty)).select(names)
    tops = upper.select(F.col("skel").alias("__s"), F.col("conv_id").alias("__c"))
    below = rows.filter(F.col("kind") == NODE).join(F.broadcast(tops), F.col("skel") == F.col("__s"), "left")
    below = below.withColumn("parent_conv_id", F.coalesce("__c", "parent_conv_id")).withColumnRenamed("ends", "ends_sha256")
    return above.unionByName(below.select(names))
