"""The stored index: scores against plain BM25, blocks that are never opened, nulls and ties."""

import collections
import math
import re
import tempfile

import numpy as np

from assaykit.operators import index

SCHEMA = "id long, title string, body string"


def plain(docs, queries, weights, k):
    fields = {"title": 1, "body": 2}
    split = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    score = collections.defaultdict(float)
    for f, weight in weights.items():
        bags = {d[0]: collections.Counter(split(d[fields[f]])) for d in docs}
        mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
        df = collections.Counter(w for b in bags.values() for w in b)
        for q, text in queries:
            for w in dict.fromkeys(split(text)):
                for d, bag in bags.items():
                    if w in bag:
                        idf = math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5))
                        score[q, d] += weight * idf * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean))
    out = []
    for q in dict(queries):
        best = sorted(((-round(s, 6), d) for (p, d), s in score.items() if p == q))[:k]
        out += [(q, d, round(-s, 6), i + 1) for i, (s, d) in enumerate(best)]
    return sorted(out)


def corpus(n=1500):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(400)]
    shares = 1 / np.arange(1, 401)
    docs = []
    for i in range(n):
        words = rng.choice(vocabulary, int(rng.integers(0, 40)), p=shares / shares.sum())
        docs.append((i, words[0] if len(words) else None, "the " + " ".join(words)))  # a word of all documents
    docs += [(n, None, None), (n + 1, "", "  "), (n + 2, docs[3][1], docs[3][2])]
    queries = [(q, "The " + " ".join(rng.choice(vocabulary, 6, p=np.full(400, 1 / 400)))) for q in range(25)] + [(90, None), (91, "zzz"), (92, "")]
    return docs, queries


def test_search_is_that_of_plain_scores(spark):
    docs, queries = corpus()
    stored = index.build_index(spark.createDataFrame(docs, SCHEMA), "id", ["title", "body"])
    for weights, k in (({"title": 2.0, "body": 1.0}, 5), ({"body": 1.0}, 1), ({"body": 1.0}, 2000)):
        got = index.search(stored, spark.createDataFrame(queries, "q long, t string"), "q", "t", weights, k, "id")
        assert sorted((r["q"], r["id"], r["score"], r["rank"]) for r in got.collect()) == plain(docs, queries, weights, k)


def test_most_pairs_are_never_scored(spark):
    rng = np.random.default_rng(6)
    texts = ["the " + " ".join(f"v{k}" for k in rng.zipf(1.3, 30) % 20_000) for _ in range(6000)]
    docs = [(i, None, t) for i, t in enumerate(texts)]
    queries = [(q, "the " + " ".join(rng.permutation(texts[q * 7].split(" ")[1:])[:3])) for q in range(25)]
    stored = index.build_index(spark.createDataFrame(docs, SCHEMA), "id", ["body"], path=tempfile.mkdtemp(prefix="spark-") + "/i")
    again = index.open_index(spark, stored.path)
    scored, later, bounds = index.plan_blocks(again, spark.createDataFrame(queries, "q long, t string"), "q", "t", {"body": 1.0}, 3)
    assert bounds.count() >= 0.9 * 25 * 6000 / index.DOCS_A_BLOCK  # the word of all documents reaches every block
    opened = later.count() + 25 * index.FIRST_BLOCKS
    print(opened, bounds.count(), scored.count())
    assert opened <= 0.35 * bounds.count() and scored.count() <= 0.35 * 25 * 6000
    got = index.search(again, spark.createDataFrame(queries, "q long, t string"), "q", "t", {"body": 1.0}, 3, "id").collect()
    assert sorted((r["q"], r["id"], r["score"], r["rank"]) for r in got) == plain([(i, None, t) for i, _, t in docs], queries, {"body": 1.0}, 3)


def test_no_documents_and_no_queries(spark):
    empty = index.build_index(spark.createDataFrame([], SCHEMA), "id", ["body"])
    q = spark.createDataFrame([(1, "a")], "q long, t string")
    assert index.search(empty, q, "q", "t", {"body": 1.0}, 3, "id").collect() == []
    full = index.build_index(spark.createDataFrame([(1, "x", "a b"), (None, "x", "a")], SCHEMA), "id", ["body"], empty=False)
    assert index.search(full, q.limit(0), "q", "t", {"body": 1.0}, 3, "id").collect() == []
    assert [r["id"] for r in index.search(full, q, "q", "t", {"body": 1.0}, 3, "id").collect()] == [1]


def test_windows_end_at_a_word(spark):
    from assaykit.operators.knowledge import context_windows

    s = spark.createDataFrame([(1, k, f"sentence number {k}") for k in range(5)], "page long, place long, text string")
    hits = spark.createDataFrame([("a", 1, 0), ("b", 1, 3), ("c", 2, 0)], "h string, page long, place long")
    got = {r["h"]: r["window"] for r in context_windows(hits, s, ["h"], "page", "place", "text", 1, 40).collect()}
    assert got == {"a": "sentence number 0 sentence number 1", "b": "sentence number 2 sentence number 3", "c": ""}
