"""The stages of the pipeline in order on a small table, each against a plain version of itself."""

import collections
import tempfile

import corpus_pipeline as cp
import numpy as np
import sentencepiece
from assaykit.llm import mixing, ngram_join, quality
from assaykit.llm.queries import model_path, read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_rng = np.random.default_rng(11)


def prose(n):
    return " ".join("".join(_rng.choice(list("abcdefghij"), _rng.integers(2, 9))) for _ in range(n))


PASSAGES = [prose(int(n)) for n in range(51, 81, 3)]
NEAR = prose(120)


def table():
    texts = [prose(40) + " " + p + " " + prose(30) for p in PASSAGES for _ in range(3)]
    texts += [NEAR, NEAR + " end", NEAR, None, "", "a b"]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[1], (2, texts[2] + " more", "en", "s0", 9), (None, prose(20), "en", "s1", 8)]


def words(t):
    return (t or "").split()


def test_stages(spark):
    rows = table()
    docs, sf_dir = spark.createDataFrame(rows, SCHEMA), tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    names, stages = zip(*cp.STAGES, strict=True)
    assert len(names) == 5

    kept = stages[0](spark, docs, sf_dir)
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    want = [tuple(r)[:5] for r in quality.score_quality(docs, model, keep=cp.COLUMNS).filter("predicted = 1").select(*cp.COLUMNS).collect()]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in kept.collect())

    one = stages[1](spark, docs, sf_dir)
    sets = collections.defaultdict(set)
    for i, t, *_ in rows:
        w = words(t)
        sets[i] |= {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    gone = {i for i in sets if i is not None and any(j is not None and j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)}
    want = {(i, t) for i, t, *_ in rows if i not in gone}
    got = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert len(got) == len(set(got)) and set(got) == want and 31 in gone and 32 in gone

    clean = stages[2](spark, one, sf_dir).collect()
    assert len(clean) == len(got)
    before = {(i, t) for i, t in got}
    for r in clean:
        assert r["n_chars"] == len(r["text"])
        if r["doc_id"] is not None and r["doc_id"] < 30 and r["doc_id"] != 2:
            assert not any(p in r["text"] for p in PASSAGES)
    assert {(r["doc_id"], r["text"]) for r in clean if r["doc_id"] in (30, 35, None)} <= before

    third = spark.createDataFrame([tuple(r) for r in clean], SCHEMA)
    mix = stages[3](spark, third, sf_dir).collect()
    sources = sorted({r["source"] for r in clean}, key=lambda s: (s is None, s or ""))
    size = [sum(len(words(r["text"])) for r in clean if r["source"] == s) for s in sources]
    targets = mixing.fill_targets(size, [1, 2, 3][: len(sources)], 3)
    for s, t in zip(sources, targets, strict=True):
        assert abs(sum(len(words(r["text"])) for r in mix if r["source"] == s) - round(t)) <= 1
    assert max(collections.Counter((r["doc_id"], r["text"]) for r in mix if r["text"]).values()) <= 3 * 2

    coded = stages[4](spark, spark.createDataFrame([tuple(r) for r in mix], SCHEMA), sf_dir).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert sorted(r["ids"] for r in coded) == sorted(sp.encode(r["text"] or "") for r in mix)
    assert all(r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in coded)


def test_passages_of_over_fifty_words_go(spark):
    """Recall of planted passages by the dedup stage, and texts without one unchanged."""
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([prose(30) + " " + p + " " + prose(25) for p in PASSAGES for _ in range(2)] + [prose(70) for _ in range(10)])], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in cp.without_repeats(spark, docs, "").collect()}
    caught = [PASSAGES[i // 2] not in got[i] for i in range(2 * len(PASSAGES))]
    assert np.mean(caught) >= 0.9
    assert all(got[r["doc_id"]] == r["text"] for r in docs.filter(f"doc_id >= {2 * len(PASSAGES)}").collect())


def test_empty_table(spark):
    sf_dir = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    assert not cp.run(spark, sf_dir).collect()


def test_classes_hold_equal_sets(spark):
    rows = spark.createDataFrame([(5, NEAR), (3, NEAR), (9, NEAR + " end")], "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["component_id"]) for r in ngram_join.jaccard_components(rows).collect()} == {5: (3, 3), 3: (3, 3), 9: (9, 3)}


def test_a_task_of_the_join_has_one_python_worker(spark, monkeypatch):
    """The rows to read were picked by one Python function and read by another, which took two workers a task."""
    plans, write = [], ngram_join.cut_few

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, *args)

    monkeypatch.setattr(ngram_join, "cut_few", noted)
    docs = spark.createDataFrame([r[:2] for r in table()], "doc_id long, text string").filter("doc_id IS NOT NULL")
    asked = spark.createDataFrame([(1,), (3,), (31,)], "id long")
    got = {r["id"]: len(r["tokens"]) for r in ngram_join._token_sets(docs, asked, 3).collect()}
    assert set(got) == {1, 3, 31} and got[31] == 117
    assert "MapInArrow" in plans[-1] and "ArrowEvalPython" not in plans[-1]


def test_the_mix_runs_no_rows_of_python_objects(spark):
    """Tables made of the driver's rows were an RDD of Python objects, which starts workers besides those of the functions."""
    sizes = mixing.measured(spark.createDataFrame([r for r in table() if r[0] is not None], SCHEMA)).select("source", "size", "__h").localCheckpoint()
    sources, _ = mixing.block_draws(sizes, 8, (1, 2, 3), 3, 23, 50)
    assert "ExistingRDD" not in sources._jdf.queryExecution().toString()
    assert [r["source"] for r in sources.orderBy("__s").collect()] == ["s0", "s1", None]
    assert mixing.block_draws(sizes.limit(0), 8, (1, 2, 3), 3, 23, 50)[0].count() == 0
