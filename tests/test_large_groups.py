"""Operators whose groups are cut into ranges, or cut down before a shuffle, against plain loops."""

import math
import random

import pytest

from assaykit.operators import comparisons, decisions, knowledge, learning, records
from assaykit.sources import scans


def test_operating_point_equals_a_loop_over_thresholds(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randint(0, 1), rng.randint(0, 400) / 400) for _ in range(3000)] + [("small", 1, 0.25), ("small", 0, 0.75), ("none", 0, None)]
    got = {r["unit"]: r for r in decisions.operating_point(spark.createDataFrame(rows, "unit string, label int, score double"), 30, 0.52).collect()}
    best = None
    for t in sorted({s for u, _, s in rows if u == "hot"}):
        kept = [y for u, y, s in rows if u == "hot" and s >= t]
        if len(kept) >= 30 and sum(kept) >= 0.52 * len(kept):
            best = max(best or (0, 0, 0.0), (sum(kept), len(kept), t))
    assert (got["hot"]["correct"], got["hot"]["emitted"], got["hot"]["threshold"]) == best
    assert got["small"]["emitted"] == 0 and got["small"]["threshold"] > 0.75 and got["none"]["emitted"] == 0


def test_cards_of_a_hub_hold_its_first_lines(spark):
    facts = [("hub", "has", f"o{i:04d}") for i in range(500)] * 2 + [("leaf", "in", "hub"), ("meta", "kind", "x"), (None, "has", "leaf")]
    labels = spark.createDataFrame([("o0000", "zz"), ("hub", "the hub")], "id string, label string")
    got = {r["entity"]: r for r in knowledge.entity_cards(spark.createDataFrame(facts, "entity string, predicate string, object string"), labels, ["kind"], 3).collect()}
    assert got["hub"]["card"] == "has: o0001\nhas: o0002\nhas: o0003" and (got["hub"]["facts"], got["hub"]["references"]) == (500, 0)
    assert (got["leaf"]["card"], got["leaf"]["references"]) == ("in: the hub", 1) and "meta" not in got and got[None]["references"] == 1


def test_node_ids_are_dense(spark):
    facts = spark.createDataFrame([(f"s{i}", "p", f"o{i % 50}", None) for i in range(2000)] + [(None, "p", "x", 1)], "subject string, predicate string, object string, year int")
    nodes, predicates, ids = knowledge.build_facts(facts)
    assert sorted(r["node"] for r in nodes.collect()) == list(range(2050)) and ids.count() == 2000 and predicates.count() == 1


def test_other_values_form_one_ring_a_predicate(spark):
    facts = spark.createDataFrame([(f"e{i}", "hot", f"v{i % 40}") for i in range(400)] + [("e0", "lone", "v")], "entity string, predicate string, value string")
    templates = spark.createDataFrame([("hot", "What of {}?"), ("lone", "Why {}?")], "predicate string, question string")
    rows = knowledge.synthesize(facts, templates, ["hot", "lone"]).collect()
    value = {(r["entity"], r["predicate"]): r["value"] for r in facts.collect()}
    assert len(rows) == 401 and all((r["answer"] == value[r["entity"], r["predicate"]]) == (r["label"] == 1) for r in rows)
    wrong = [r for r in rows if r["label"] == 0]
    assert 120 < len(wrong) < 280 and all(r["predicate"] == "hot" and r["answer"].startswith("v") for r in wrong)
    assert len({(value[r["entity"], "hot"], r["answer"]) for r in wrong}) == len({value[r["entity"], "hot"] for r in wrong})


def test_strict_lines_name_file_and_number(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n' * 50)
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n[3]\nnot\n')
    with pytest.raises(ValueError, match=r"bad\.jsonl:4: .*\[3\]"):
        scans.read_jsonl(spark, str(tmp_path), "a int")
    assert scans.read_jsonl(spark, str(tmp_path), "a int", mode="lenient").count() == 52


def test_too_many_templates_are_an_error(spark):
    many = spark.range(records.MOST_TEMPLATES + 1).selectExpr("string(id) AS template", "'h' AS head", "'t' AS tail")
    with pytest.raises(ValueError, match="templates"):
        records.assemble(spark.createDataFrame([(1, "x")], "k int, text string"), many, "k", "text")


def test_weights_of_terms_are_made_where_a_text_is_read(spark):
    """Every term of every text was shuffled; now only the counts of texts a term are."""
    rows = spark.createDataFrame([(1, "red blue red"), (2, "Blue rêd"), (3, None), (4, "red blue blue sky"), (5, "sky")], "k long, t string")
    got = learning.word_tfidf(rows, "k", "t")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    one = [r for r in got.collect() if r["k"] == 1]
    idf = {"red": math.log(6 / 4) + 1, "blue": math.log(6 / 4) + 1, "red blue": math.log(6 / 3) + 1, "blue red": math.log(6 / 3) + 1}
    raw = {"red": (1 + math.log(2)) * idf["red"], "blue": idf["blue"], "red blue": idf["red blue"], "blue red": idf["blue red"]}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    assert {r["term"]: round(r["weight"], 9) for r in one} == {t: round(w / norm, 9) for t, w in raw.items()}
    assert {r["k"] for r in got.collect()} == {1, 2, 4, 5}


def test_repeat_consistency_takes_a_bounded_number_of_rows_a_task(spark, monkeypatch):
    """The number of tasks was fixed, or their bytes were, so the memory of one grew with the table."""
    rng = random.Random(3)
    rows = [("g", "hot", rng.randint(0, 300), rng.choice(["N", "A", "R", None])) for _ in range(500)]
    rows += [(rng.choice(["g", "h", None]), rng.choice(["f", "k", None]), rng.choice([*range(40), None]), rng.choice(["N", "A", "R"])) for _ in range(300)]
    monkeypatch.setattr(comparisons, "ROWS_A_TASK", 50)
    out = comparisons.repeat_consistency(spark.createDataFrame(rows, "g string, f string, r long, label string"), ["g"], ["f"], "r", "label", "N")
    plan = out._jdf.queryExecution().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and ", 16), REPARTITION_BY_NUM" in plan  # 800 rows, 50 a task
    one = {}
    for g, f, r, label in rows:
        known = one.get((g, f, r))
        one[g, f, r] = label if known is None or (label is not None and label < known) else known
    want = {}
    for (g, f, r), x in one.items():
        for (h, k, s), y in one.items():
            if (g, f) == (h, k) and (-1 if r is None else r) < (-1 if s is None else s):
                plain, other = x is not None and x != "N", y is not None and y != "N"
                have = want.setdefault(g, [0, 0, 0, 0])
                for i, holds in enumerate((True, x == y, plain == other, plain and other and x != y)):
                    have[i] += holds
    assert {r[0]: list(r)[1:] for r in out.collect()} == want and len(want) == 3
