"""Guards, edge cases and numerical checks that the SQL comparison does not reach."""

import collections
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from assaykit.functions import parsing, plugged
from assaykit.functions import text as T
from assaykit.operators import comparisons, joins, knowledge, learning, ranks, records, relations, sampling
from assaykit.plans.queries import queries
from assaykit.sources import scans

DATA = "/root/testdata/sf0.001"


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_strict_scans_name_the_line(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([('{"a": 1}',), ("[2]",)], "value string").coalesce(1).write.text(f"{folder}/x")
    with pytest.raises(ValueError, match=r"part-.*\[2\]"):
        scans.read_jsonl(spark, f"{folder}/x", "a long")
    assert [r["a"] for r in scans.read_jsonl(spark, f"{folder}/x", "a long", "lenient").collect()] == [1]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        scans.read_jsonl(spark, f"{folder}/none", "a long").collect()


@pytest.mark.parametrize("row,rule", [(("1", "true", "0.5"), "repeated"), (("2", "maybe", "0.5"), "bad_deceptive"), (("2", None, "0.5"), "bad_deceptive"), (("2", "f", "x"), "bad_score"), (("2", "f", "nan"), "bad_score"), (("2", "f", "-0.1"), "out_of_range")])
def test_broken_predictions_are_told(spark, row, rule):
    rows = scans.prediction_rows(spark.createDataFrame([("1", " Yes", "1"), row], "index string, deceptive string, score string")).collect()
    assert any(r[rule] for r in rows) and (rows[0]["deceptive"] if rule == "repeated" else 1) == 1
    with pytest.raises(ValueError, match="score"):
        scans.prediction_rows(spark.createDataFrame([("1", "t")], "index string, deceptive string"))


def test_alignment_is_strict_or_partial(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "index long, label int")
    preds = lambda *ids: spark.createDataFrame([(i, 0.5) for i in ids], "index long, score double")
    assert relations.align(preds(1, 2), labels).count() == 2
    assert relations.align(preds(2), labels, partial=True).count() == 1
    for bad in (preds(1), preds(1, 3), preds(1, 2, 3)):
        with pytest.raises(ValueError):
            relations.align(bad, labels)
    with pytest.raises(ValueError):
        relations.align(preds(7), labels, partial=True)


def test_one_to_one_joins_guard_their_sides(spark):
    a = spark.createDataFrame([(1, 0, 0.1), (2, None, 0.2)], "index long, label int, x double")
    b = spark.createDataFrame([(1, 0, 0.3), (2, None, 0.4)], "index long, label int, y double")
    assert {tuple(r) for r in joins.join_one_to_one(a, b, ["index"]).select("index", "x", "y").collect()} == {(1, 0.1, 0.3), (2, 0.2, 0.4)}
    for bad, message in ((b.unionByName(b), "duplicate"), (b.filter("index = 1"), "lost"), (b.withColumn("label", F.lit(1)), "disagree")):
        with pytest.raises(ValueError, match=message):
            joins.join_one_to_one(a, bad, ["index"])


def test_unions_banks_and_marks_guard_their_keys(spark):
    t = spark.createDataFrame([(1, 0.5)], "k long, score double")
    with pytest.raises(ValueError):
        records.union_tagged({"a": t, "b": t}, "k")
    with pytest.raises(ValueError):
        records.feature_bank(t.select("k"), {"x": t.unionByName(t)}, "k")
    with pytest.raises(ValueError):
        records.mark_label_only(t.withColumn("y", F.lit(1)), t.withColumn("y", F.lit(0)), "k", "y")
    with pytest.raises(ValueError):
        sampling.full_sample(t.withColumn("g", F.lit(1)).withColumnRenamed("k", "index"), 2, "g", "g")


def test_places_within_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 9 == 0 else int(i % 3), int(rng.integers(0, 40)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g int, x int, i int")
    got = {r["i"]: (r["__r"], r["__n"]) for r in ranks.value_places(df, ["g"], F.col("x").cast("double"), ["i"]).collect()}
    for g in (None, 0, 1, 2):
        own = sorted((x, i) for h, x, i in rows if h == g)
        assert [got[i] for _, i in own] == [(k + 1, len(own)) for k in range(len(own))]
    mean = {r["i"]: r["r"] for r in ranks.average_places(df, ["g"], "x", "r").collect()}
    own = sorted(x for h, x, _ in rows if h == 1)
    assert all(mean[i] == own.index(x) + (own.count(x) + 1) / 2 for h, x, i in rows if h == 1)
    assert ranks.digest_places(df.limit(0), ["g"], "s", "i").count() == 0


def test_pair_counts_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 12)), int(rng.integers(0, 9)), int(rng.integers(0, 2)), "u") for _ in range(60)] + [(3, 3, 1, "v")]
    c = {r["unit"]: r for r in comparisons.pair_orders(spark.createDataFrame(rows, "x int, y int, label int, unit string"), ["unit"], "x", "y").collect()}
    own = [r for r in rows if r[3] == "u"]
    pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
    assert c["u"]["up"] == sum((a[0] - b[0]) * (a[1] - b[1]) > 0 for a, b in pairs) and c["u"]["down"] == sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for a, b in pairs)
    assert c["u"]["tied_both"] == sum(a[:2] == b[:2] for a, b in pairs) and c["v"]["up"] == 0


def test_hashed_features(spark):
    got = queries()["hashed_features"](spark, DATA).filter("doc_id < 20").collect()
    want = collections.Counter()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 20 AND text IS NOT NULL").select("doc_id", parsing.terms(F.col("text")).alias("t")).collect():
        for t in r["t"]:
            want[r["doc_id"], zlib.crc32(f"term={t}".encode()) & 8191] += 1
    assert {(r["doc_id"], r["slot"]): r["value"] for r in got} == want


def test_logistic_model_is_at_its_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=200) > 0).astype(float)
    df = spark.createDataFrame([(Vectors.dense(a.tolist()), float(b)) for a, b in zip(x, y, strict=True)], ["features", "label"])
    m = learning.fit_logistic(df, "features", "label", c=2.0)
    w, b = np.array(m.coefficients), m.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(2.0 * x.T @ (p - y) + w).max() < 1e-2 and abs((p - y).sum()) < 1e-3


def test_each_row_is_scored_by_the_other_groups(spark):
    for name in ("group_scores", "length_scores", "nested_blend"):
        rows = queries()[name](spark, DATA).collect()
        assert len(rows) == len({r["index"] for r in rows}) == 87


def test_lengths_are_measured_before_the_fits(spark):
    """The fits read what was written once; no text goes with it."""
    rows = [(i, "ab"[i % 2], "word " * (1 + i % 7), int(i % 7 > 3)) for i in range(60)]
    out = learning.length_control(spark.createDataFrame(rows, "index long, unit string, text string, y int"), "unit", "text", "y")
    assert "text" not in out.columns and out.count() == 60
    assert out.inputFiles() and all("cut-" in f for f in out.inputFiles())


def test_oracle_compares_equal_term_sets_once(spark, capsys):
    """All levels come from one join of claims and facts, in which facts of the same terms are one row."""
    claims = spark.createDataFrame([(1, "a", "where", "lies north"), (2, "a", "north lies", "north lies"), (3, "b", "what", "south"), (4, "c", "x", "east")], "claim long, entity string, conversation string, target string")
    facts = spark.createDataFrame([("a", "p", "north"), ("a", "q", "a north"), ("a", "q", "one two three four five north"), ("b", "q", "Some thing else with south"), ("b", "p", None)], "entity string, predicate string, value string")
    out = knowledge.relation_oracle(claims, facts, {"all": F.lit(True), "p": F.col("predicate") == "p", "none": F.lit(False)}, 0.5)
    out.explain()
    assert sum("Join" in line for line in capsys.readouterr().out.splitlines()) == 2
    assert sorted(map(tuple, out.collect())) == [("all", 4, 2, 1), ("none", 4, 0, 0), ("p", 4, 1, 1)]


def test_probes_and_routers_beat_chance(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, i % 2, i % 3 == 0, [float(v) for v in rng.normal(size=4) + (2.0 if i % 3 == 0 else -2.0)]) for i in range(120)]
    df = spark.createDataFrame(vectors + [(200, 0, True, None)], "vec_id long, fold long, y boolean, embedding array<double>").withColumn("y", F.col("y").cast("int"))
    rows = learning.embedding_probe(df, "fold", "embedding", "y").collect()
    assert len(rows) == 120 and np.mean([(r["oof"] > 0.5) == (r["y"] == 1) for r in rows]) > 0.95
    assert {r["side"]: r["top_1"] for r in queries()["routed_languages"](spark, DATA).collect()}["test"] > 0.8


def test_scorers_are_held_to_their_range(spark):
    df = spark.range(10).repartition(2)
    assert {r["id"]: r["score"] for r in plugged.score_with(df, lambda b: b["id"] / 10, 3).collect()} == {i: i / 10 for i in range(10)}
    with pytest.raises(Exception, match="between 0 and 1"):
        plugged.score_with(df, lambda b: b["id"] * 1.0).collect()
    with pytest.raises(KeyError):
        plugged.rule("no such rule")


def test_redirects_follow_long_chains_and_stop_in_cycles(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(300)] + [("a", "b"), ("b", "a"), ("c", "lost")]
    got = {r["name"]: r["page"] for r in relations.resolve_redirects(spark.createDataFrame(edges, "name string, target string"), spark.createDataFrame([("n300", 7)], "name string, page long")).collect()}
    assert got == {f"n{i}": 7 for i in range(300)}


def test_curricula_and_twins(spark):
    rows = [(i, "refute" if i % 2 else "support") for i in range(40)]
    got = collections.Counter(r["kind"] for r in knowledge.curriculum(spark.createDataFrame(rows, "k long, kind string"), "k", "kind", 4).collect())
    assert got == {"refute": 12, "support": 4}


def test_texts_with_nulls_and_edges(spark):
    for make in (parsing.normalize_tag, T.unescape, parsing.numbers, lambda t: parsing.parse_fact(t)["value"], T.prose_sentences, T.key_terms, lambda t: T.last_field(t, "x")):
        assert one(spark, None, make) is None
    assert one(spark, None, parsing.normalize_messages) == []
    assert one(spark, "a &amp;lt; b", T.unescape) == "a &lt; b"
    assert one(spark, "born in 2200 or 1499", lambda t: F.transform(T.salient_values(t), lambda v: v["kind"])) == ["year", "cardinal"]
    assert one(spark, "org/train-extra-qa-beta-13b-none", lambda t: parsing.parse_dataset_name(t, ["train", "train-extra"], ["alpha-7b", "beta-13b"])).asDict() == {"split": "train-extra", "task": "qa", "model_id": "beta-13b", "lora_id": None}
    assert one(spark, 'x {"v": "no"} y', lambda t: parsing.parse_json_enum(t, {"v": ["yes"]}, ["why"])["errors"]) == ["v", "why"]
    assert one(spark, "USER: a\n\nASSISTANT: b\n\nc\n\nUSER: d", parsing.final_exchange).asDict() == {"question": "d", "answer": "b\n\nc"}
    assert one(spark, "abcdefghij", lambda t: T.truncate_text(t, 6, "third")) == "ab ... ghij"


def test_empty_tables_give_no_rows(spark):
    p = spark.createDataFrame([], "unit string, scenario string, index long, label int, score double, decision int, x double, y double")
    for df in (sampling.sample_fraction(p, 0.5, ["unit"]), sampling.half_split(p, ["unit"]), comparisons.pair_orders(p, ["unit"], "x", "y"), comparisons.order_changes(p, "unit", "index", "x", "y"), relations.assign_donors(p, "unit", "index")):
        assert not df.collect()


def test_redirects_send_no_table_through_the_driver(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(30)], "name string, target string")
    got = relations.resolve_redirects(edges, spark.createDataFrame([("n30", 7)], "name string, page long"))
    assert got.count() == 30
    assert "BroadcastExchange" not in got._jdf.queryExecution().executedPlan().toString()
