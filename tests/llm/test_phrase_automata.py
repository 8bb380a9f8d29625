"""Removal of repeated passages against a plain walk over all windows, by every plan."""

import collections
import hashlib
import re
import tempfile

import numpy as np
import pytest

from assaykit.llm import phrase_automata, queries

SCHEMA = "doc_id long, text string, n_words int, kept long, k string, lang string"


def plain(rows, span=20):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    least = {}
    key = lambda i: float("inf") if i is None else i
    for (i, *_), ws in zip(rows, words, strict=True):
        for s in range(len(ws) - span + 1):
            w = tuple(ws[s : s + span])
            least[w] = min(least.get(w, float("inf")), key(i))
    out = []
    for (i, *_), ws in zip(rows, words, strict=True):
        gone, seen = [False] * len(ws), set()
        for s in range(len(ws) - span + 1):
            w = tuple(ws[s : s + span])
            if least[w] < key(i) or w in seen:
                gone[s : s + span] = [True] * span
            seen.add(w)
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def documents(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefgé日"), rng.integers(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    passages = [text(int(n)) for n in rng.integers(18, 90, 6)]
    texts = []
    for _ in range(60):
        parts = [text(int(rng.integers(0, 40)))]
        for p in rng.choice(6, int(rng.integers(0, 4))):
            words = passages[p].split(" ")
            if rng.random() < 0.4:
                words[int(rng.integers(len(words)))] = "edited"
            if rng.random() < 0.3:
                words = words[int(rng.integers(0, 15)) :]
            parts += ["\n\t".join(words) if rng.random() < 0.2 else " ".join(words), text(int(rng.integers(0, 25)))]
        texts.append("  ".join(parts))
    texts += [texts[0], texts[1] + " end", None, "", " \n", "a " * 90, "x y " * 60, "a b c", passages[0], "short\x00 null " * 15]
    ids = [int(i) for i in rng.permutation(len(texts))]
    rows = [(i, t, 9, 9, "x", "en") for i, t in zip(ids, texts, strict=True)]
    return rows + [(ids[3], texts[3], 9, 9, "x", "en"), (ids[3], texts[3], 9, 9, "x", "en"), (ids[4], texts[5], 9, 9, "x", "en"), (None, texts[6], 9, 9, "x", "en"), (None, texts[7], 9, 9, "x", "en"), (-5, texts[8], 9, 9, "x", "en")]


def got(spark, rows):
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    out = queries.queries()["op12_phrase_automata"](spark, path).collect()
    return collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_plain(spark, seed):
    rows = documents(seed)
    assert got(spark, rows) == plain(rows)


def test_cut_and_copied_shards(spark, monkeypatch):
    monkeypatch.setattr(phrase_automata, "LETTERS_A_SHARD", 60)
    monkeypatch.setattr(phrase_automata, "CONTEXTS_A_COPY", 2)
    rows = documents(2)
    assert got(spark, rows) == plain(rows)


def test_seeds_and_kinds_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr(phrase_automata, "MOST_SEEDS", 0)
    monkeypatch.setattr(phrase_automata, "MOST_KINDS", 0)
    rows = documents(3)
    assert got(spark, rows) == plain(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrase_automata, "PIECE_WORDS", 64)
    monkeypatch.setattr(phrase_automata, "PIECE_BYTES", 50)
    rows = documents(4)
    assert sum((phrase_automata.Contexts(*_body(t)).hi - phrase_automata.Contexts(*_body(t)).lo + 1).sum() for _, t, *_ in rows) > 0
    assert got(spark, rows) == plain(rows)


def _body(text):
    b = np.frombuffer((text or "").encode(), np.uint8)
    return b, np.array([0, len(b)])


def test_a_text_of_over_a_megabyte(spark):
    shared = " ".join(f"s{k}" for k in range(50))
    long_ = " ".join(f"x{k}" for k in range(180_000)) + " " + shared
    rows = [(2, long_, 0, 0, "", ""), (1, shared, 0, 0, "", ""), (3, long_, 0, 0, "", "")]
    assert got(spark, rows) == plain(rows)


def test_columns_and_hits_of_equal_letters(spark):
    automaton = phrase_automata.Automaton(np.array([5, 9], np.uint64).view(np.int64), np.array([1, 2]), [b"ab" * 10, b"ab" * 10], 20)
    import pyarrow as pa

    first, base = automaton.firsts(pa.array([b"ab" * 10, b"ab" * 10, b"xab" + b"ab" * 10], pa.binary()), pa.array([[9], [7], [1, 5, 1, 9]], pa.list_(pa.int64())))
    assert first.tolist() == [2, phrase_automata._LAST, phrase_automata._LAST, 1, phrase_automata._LAST, 2] and base.tolist() == [0, 1, 2, 6]
    out = phrase_automata.remove_repeated_passages(spark.createDataFrame(documents(), SCHEMA))
    assert out.columns == ["doc_id", "text", "k", "lang", "n_words", "n_removed", "kept"]
    assert phrase_automata.remove_repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []
