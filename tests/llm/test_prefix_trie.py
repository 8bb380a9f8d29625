"""The prefix trie against a plain walk over all prefixes, with skeletons of every size."""

import collections
import hashlib
import tempfile
import zlib

import numpy as np
import pytest

from assaykit.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path int"


def plain(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    trie = collections.defaultdict(list)
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:])
        for d in range(len(built[c]) + 1):
            trie[built[c][:d]].append(c)
    children = collections.defaultdict(list)
    for node in trie:
        if node:
            children[node[:-1]].append(node)

    def sums(node):
        leaves, saved = int(not children[node]), (len(trie[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for c in children[node]:
            a, b = sums(c)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for node, members in trie.items():
        ends = ",".join(str(c) for c in sorted(members) if built[c] == node)
        up = min(trie[node[:-1]]) if node else None
        out.append((min(members), len(node), up, len(members), len(children[node]), *sums(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=1, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(-4, n):
        if c % 7 == 3:
            continue
        for t in range(int(rng.integers(0, 14))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"t{t} {'é' * int(rng.integers(0, 2))}" if c % 3 else f"own {c} {t}", "x", 1))
    for c in range(1000, 1040):  # a hot conversation
        rows += [(c, t, "user", f"hot {t}", "x", 1) for t in range(12)]
    rows += [(2000, None, None, None, None, None), (2000, 3, "user", "", None, None), (2000, None, None, None, None, None), (None, 0, "user", "lost", None, None)]
    return rows


@pytest.mark.parametrize("partitions,samples", [("1", 8), ("4", 8), ("40", 8), ("200", 1)])
def test_against_plain(spark, monkeypatch, partitions, samples):
    monkeypatch.setattr(prefix_trie, "SAMPLES_A_SHARD", samples)
    rows = conversations()
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = queries.queries()["op13_prefix_trie"](spark, path).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_long_paths_are_not_splitters_and_deep_chains_add_up(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "MOST_SPLITTER_BYTES", 64)
    rows = [(c, t, "user", f"{t}", "x", 1) for c in (5, 10, 15) for t in range(300)] + [(20, 0, "user", "0", "x", 1)]
    got = prefix_trie.trie_nodes(prefix_trie.rebuilt_paths(spark.createDataFrame(rows, SCHEMA)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_original_conversations_and_ties(spark):
    rows = [(1, 0, "b", "x", "", 0), (1, 0, "a", "y", "", 0), (2, 0, "a", "y", "", 0), (2, 0, "b", "x", "", 0)]
    paths = prefix_trie.conversation_paths(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({bytes(r["path"]) for r in paths}) == 1 and all(r["sizes"] == [1, 1] for r in paths)
    nodes = {r["depth"]: r["n_convs"] for r in prefix_trie.trie_nodes(prefix_trie.conversation_paths(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert nodes == {0: 2, 1: 2, 2: 2}


def test_no_conversations(spark):
    assert prefix_trie.trie_nodes(prefix_trie.rebuilt_paths(spark.createDataFrame([], SCHEMA))).collect() == []
