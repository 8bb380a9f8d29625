"""Small cases with nulls, empty and repeated texts, clashing columns; brute force where SQL cannot tell."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import fingerprints, mixing, ngram_join, pieces, quality, sharding, suffix_dedup, token_counts, topk_search, toxicity
from assaykit.llm.queries import model_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, ids string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", None if i % 4 == 3 else f"s{i % 2}", len(t or ""), 9, "x") for i, t in enumerate(texts)], SCHEMA)


WORDS = [f"w{k}" for k in range(400)]
BASE = " ".join(WORDS[:100])
TEXTS = [BASE, BASE, BASE + " tail", None, "", "  \n ", "one two", "ONE two", " ".join(WORDS[100:300]), " ".join(WORDS[102:300]) + " é ü", "a\nb\nc", "c\na\nb", "x▁y  z "]


def test_jaccard_components(spark):
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(table(spark, TEXTS), links=True).collect()}
    sets = []
    for t in TEXTS:
        w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    parent = list(range(len(TEXTS)))
    alike = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    assert [got[i]["n_links"] for i in range(len(TEXTS))] == [sum(alike(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    for i in range(len(TEXTS)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    assert [got[i]["n_shingles"] for i in range(len(TEXTS))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(TEXTS))] == parent


def test_large_group_of_near_copies_meets_in_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL", 20)
    rng = np.random.default_rng(1)
    texts = []
    for g in range(2):
        for _ in range(90):
            w = [f"g{g}x{k}" for k in range(120)]
            w[rng.integers(120)] = f"r{rng.integers(10**9)}"
            texts.append(" ".join(w))
    out = ngram_join.jaccard_components(table(spark, texts), links=True).collect()
    assert sorted(collections.Counter(r["component_id"] for r in out).values()) == [90, 90]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for t in texts]
    links = [sum(100 * len(a & b) >= 80 * len(a | b) for b in sets) - 1 for a in sets]
    assert [r["n_links"] for r in sorted(out, key=lambda r: r["doc_id"])] == links


def test_divide_skip_is_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(60)]
    index = ngram_join.DivideSkip(sets)
    for q in sets:
        brute = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
        assert index.search(q, np.ones(60, bool)).tolist() == brute


def test_shards_keep_all_rows(spark):
    out = sharding.shuffle_shards(table(spark, TEXTS), 3, bucket_bytes=500).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(len(TEXTS)))
    for s in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(TEXTS) / 3) < 1
    assert not sharding.shuffle_shards(table(spark, TEXTS).limit(0), 3).collect()


def test_fingerprints_are_order_free_and_homomorphic(spark):
    df = fingerprints.fingerprint_documents(table(spark, TEXTS)).orderBy("doc_id").collect()
    assert df[10]["fingerprint"] == df[11]["fingerprint"] and df[0]["fingerprint"] == df[1]["fingerprint"] != df[2]["fingerprint"]
    nxt = TEXTS[1:] + TEXTS[:1]
    for r, t, n in zip(df, [t or "" for t in TEXTS], [t or "" for t in nxt], strict=True):
        k = len(t) // 4
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
    v = lambda s: fingerprints.vector(fingerprints.line_hashes(F.lit(s)))
    one = spark.range(1).select(v("a\nb").alias("ab"), v("a").alias("a"), v("b").alias("b"))
    r = one.select(fingerprints.add(F.col("a"), F.col("b")).alias("s"), "ab", fingerprints.remove(F.col("ab"), F.col("a")).alias("d"), "b").first()
    assert r["s"] == r["ab"] and r["d"] == r["b"]


def test_classifiers_score_every_row(spark):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, TEXTS)
    for out in (quality.score_quality(docs, quality.fit_quality(docs, labels)), toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))):
        rows = out.collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_trees_learn_held_out_rows():
    x = np.random.default_rng(3).normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = quality.BoostedTrees().fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 6) / 4], 0) for i in range(120)] + [(200, None, 0), (201, [float("nan")] * 6, 0), (202, [None] * 6, 0)]
    got = topk_search.top_k_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    w = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows[:120]}
    want = [(q, r + 1, c, s) for q in (0, 50, 100) for r, (s, c) in enumerate(sorted(((-int(w[q] @ w[c]), c) for c in w if c != q))[:5])]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], -r["score"]) for r in got) == want


def test_mix_takes_exact_targets(spark):
    mix = mixing.mix_sources(table(spark, TEXTS), block_words=40)
    taken = collections.Counter()
    per_doc = collections.Counter()
    for r in mix.collect():
        taken[r["source"]] += r["words"]
        per_doc[r["doc_id"]] += r["words"]
    for r in mix.select("source", "target").distinct().collect():
        assert taken[r["source"]] == round(r["target"])
    assert all(n <= 3 * len((TEXTS[d] or "").split()) for d, n in per_doc.items())
    assert mixing.fill_targets([10, 10, 100], [1, 2, 3], 3) == [22.5, 30.0, 67.5]


def test_repeats_match_brute_force(spark):
    rng = np.random.default_rng(5)
    piece = lambda n: "".join(rng.choice(list("abcdefgé \n"), n))
    shared = piece(700)
    texts = [piece(300) + shared + piece(200), shared[:450] + piece(500), "ab" * 500, None, "", piece(399), shared[100:], piece(900)]
    texts += [texts[-1]]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(table(spark, texts)).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[s : s + 400] for b in raw for s in range(len(b) - 399))
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 399):
            if seen[b[s : s + 400]] > 1:
                gone[s : s + 400] = True
        assert bytes(got[i]["kept"]) == bytes(x for x, g in zip(b, gone, strict=True) if not g)


@pytest.mark.parametrize("most", [16_384, 1])
def test_crowded_tokens_are_counted_over_all_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_IN_BUCKET", most)
    rng = np.random.default_rng(6)
    shared = "".join(rng.choice(list("abcdefgh"), 430))
    texts = ["".join(rng.choice(list("ijklmn"), 100 + k)) + shared + "".join(rng.choice(list("ijklmn"), 90)) for k in range(6)]
    rows = suffix_dedup.remove_repeats(table(spark, texts)).collect()
    assert all(r["n_removed"] >= 430 and r["n_removed"] < 440 for r in rows)


def test_token_counts_and_prefixes(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = [*TEXTS, " lead", "a  b   c", "日本 \x00 🙂"]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(table(spark, texts), model_path(), keep_prefixes=True).collect()}
    counter = token_counts.PrefixCounter(model_path())
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(sp.encode(t or ""))
        assert (got[i]["prefix_tokens"] or [0])[-1] == got[i]["n_tokens"]
        body = (t or "").encode()
        ends, sums = (np.array(got[i][c] or [], np.int64) for c in ("prefix_bytes", "prefix_tokens"))
        for n in range(0, len(t or "") + 2, 1 if len(body) < 20 else 7):
            assert counter.prefix_count(body, ends, sums, len((t or "")[:n].encode())) == len(sp.encode((t or "")[:n]))
    cuts = table(spark, texts).join(token_counts.count_tokens(table(spark, texts), model_path(), keep_prefixes=True).select("doc_id", "prefix_bytes", "prefix_tokens"), "doc_id").withColumn("cut_bytes", F.lit(4))
    assert {r["doc_id"]: r["cut_tokens"] for r in token_counts.prefix_counts(cuts, model_path()).collect()}[0] == len(sp.encode(BASE[:4]))


def test_pieces_round_trip(spark):
    coded = pieces.encode_texts(table(spark, TEXTS), model_path())
    back = {r["doc_id"]: r for r in pieces.decode_ids(coded, model_path()).collect()}
    for i, t in enumerate(TEXTS):
        assert back[i]["decoded"] == (t or "").replace("▁", " ") and back[i]["parity"]
