"""Search without an index: scores against plain BM25, parts that share their row's title, ties, nulls, several passes."""

import os

from test_index import SCHEMA, corpus, plain

from assaykit.functions.arrowtext import shared_dir
from assaykit.operators import knowledge, retrieval, scan


def _rows(df, key="id"):
    return sorted((r["q"], r[key], r["score"], r["rank"]) for r in df.collect())


def test_scan_is_plain_search(spark):
    docs, queries = corpus()
    table, asked = spark.createDataFrame([*docs, (None, "x", "the")], SCHEMA).repartition(3), spark.createDataFrame([*queries, (None, "the")], "q long, t string")
    for weights, k in (({"title": 2.0, "body": 1.0}, 5), ({"body": 1.0}, 1), ({"body": 1.0}, 2000)):
        assert _rows(scan.scan_search(table, asked, "q", "t", weights, k, "id")) == plain(docs, queries, weights, k)


def test_small_steps_and_several_passes_change_nothing(spark, monkeypatch):
    docs, queries = corpus(300)
    monkeypatch.setattr(scan, "QUERIES_A_PASS", 9)
    table = spark.createDataFrame(docs, SCHEMA)
    assert _rows(scan.scan_search(table, spark.createDataFrame(queries, "q long, t string"), "q", "t", {"title": 2.0, "body": 1.0}, 5, "id")) == plain(docs, queries, {"title": 2.0, "body": 1.0}, 5)


def test_parts_share_a_title_that_is_read_once(spark):
    docs, queries = corpus(400)
    pages, flat = [], []
    for i, title, _ in docs:
        own = [d[2] for d in docs[i % 7 : i % 7 + i % 5]]
        pages.append((i, title, [(i * 10 + j, t) for j, t in enumerate(own)] if i % 9 else None))
        flat += [(i * 10 + j, title, t) for j, t in enumerate(own)] if i % 9 else []
    table = spark.createDataFrame(pages, "page long, title string, s array<struct<id: long, body: string>>")
    found = scan.scan_search(table, spark.createDataFrame(queries, "q long, t string"), "q", "t", {"title": 2.0, "body": 1.0}, 6, "id", parts="s")
    assert _rows(found) == plain(flat, queries, {"title": 2.0, "body": 1.0}, 6)


def test_string_keys_and_no_words(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "X  y"), ("c", None), ("d", "")], "k string, t string")
    asked = spark.createDataFrame([(1, "y"), (2, "."), (3, "zzz")], "q long, t string")
    assert [(r["q"], r["k"], r["rank"]) for r in scan.scan_search(docs, asked, "q", "t", {"t": 1.0}, 1, "k").collect()] == [(1, "a", 1)]
    assert scan.scan_search(docs, asked.filter("q > 1"), "q", "t", {"t": 1.0}, 1, "k").collect() == []
    assert scan.scan_search(docs.limit(0), asked, "q", "t", {"t": 1.0}, 1, "k").collect() == []
    assert scan.scan_search(docs, asked.limit(0), "q", "t", {"t": 1.0}, 1, "k").columns == ["q", "k", "score", "rank"]


def test_a_question_asked_once_writes_no_index(spark):
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    docs = spark.createDataFrame([(i, f"word w{i % 3}") for i in range(30)], "k long, t string")
    found = retrieval.bm25(docs, spark.createDataFrame([(1, "w2")], "q long, t string"), "k", "t", "q", "t", 3)
    assert [r["k"] for r in found.orderBy("rank").collect()] == [2, 5, 8]
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == before


def test_titles_are_not_repeated_by_sentences(spark):
    """A document of one line is its own title: with each sentence it was written as often as it has sentences."""
    line = " ".join(f"Sentence number {i} tells something about the thing{i % 50}." for i in range(400))
    lists = retrieval.page_lists(spark.createDataFrame([(1, line, line + " " + line.upper()), (2, None, None)], "k long, h string, t string"), "k", "h", "t")
    rows = {r["k"]: r for r in lists.collect()}
    assert len(rows) == 2 and len(rows[1]["s"]) == 400 and rows[2]["s"] == []
    plain_rows = retrieval.page_sentences(spark.createDataFrame([(1, line + " " + line.upper())], "k long, t string"), "k", "t").collect()
    assert sorted((r["place"], r["sentence"]) for r in plain_rows) == sorted((p["place"], p["text"]) for p in rows[1]["s"])


def test_windows_shuffle_only_named_sentences(spark):
    sentences = spark.createDataFrame([(d, p, f"Page {d} place {p}.") for d in range(50) for p in range(20)], "page long, place long, text string")
    hits = spark.createDataFrame([(1, 3, 0), (2, 7, 19), (3, 99, 4)], "q long, page long, place long")
    got = knowledge.context_windows(hits, sentences, ["q"], "page", "place", "text")
    assert {r["q"]: r["window"] for r in got.collect()} == {1: "Page 3 place 0. Page 3 place 1.", 2: "Page 7 place 18. Page 7 place 19.", 3: ""}
    assert "LeftSemi" in got._jdf.queryExecution().toString()
