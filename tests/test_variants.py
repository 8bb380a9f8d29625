"""Candidate picks, evidence variants, synthetic candidates and gated parameters on small tables."""

from assaykit.operators import evidence, knowledge, learning, records


def test_hard_negatives_go_by_choice_kind_popularity_and_id(spark):
    rows = [(1, 1, 0, 0, "far", 9), (1, 2, 0, 0, "near", 1), (1, 3, 1, 1, "near", 9), (1, 4, 0, 1, None, None), (1, 5, 0, None, "near", 1), (2, 1, None, 0, "far", 0), (3, 1, 1, 0, "far", 0)]
    df = spark.createDataFrame(rows, "row int, c int, decisive int, chosen int, kind string, popularity int")
    out = evidence.hard_negatives(df, "row", "c", "decisive", "chosen", "kind", "popularity", 3, ["near", "far"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 4), (1, 2, 2), (1, 3, 5), (2, 1, 1)]
    assert evidence.hard_negatives(df.limit(0), "row", "c", "decisive", "chosen", "kind", "popularity", 3, ["near"]).count() == 0


def test_picked_variants_take_topical_rejects_first(spark):
    rows = [(1, 1, -0.9, 1, 5, 0, "a"), (1, 2, -0.5, 0, 5, 0, "b"), (1, 3, 0.6, 0, 5, 0, None), (1, 4, 0.0, 0, 1, 0, "d"), (1, 5, 0.1, 0, 9, 1, "e"), (2, 1, 0.0, 0, 3, None, "f")]
    df = spark.createDataFrame(rows, "key int, c int, gain double, decisive int, size int, topical int, text string")
    picks = evidence.pick_candidate(df, "key", "gain", "decisive", "size", "c", 0.2, "topical")
    out = records.picked_variants(picks, df, "key", "c", "text")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "harmful", "b", 2), (1, "helpful", "", 3), (1, "insufficient", "e", 5), (2, "insufficient", "f", 1)]
    plain = evidence.pick_candidate(df, "key", "gain", "decisive", "size", "c", 0.2).filter("key = 1").first()
    assert plain["rejected"] == 4


def test_mixed_variants_hold_both_sides(spark):
    df = spark.createDataFrame([(1, "own"), (2, None)], "key int, text string")
    donors = spark.createDataFrame([(1, 2), (2, 1)], "key int, donor int")
    assert sorted(tuple(r) for r in records.mixed_variants(df, "key", "text", donors).collect()) == [(1, "mixed", "own\n", 2), (2, "mixed", "\nown", 1)]


def test_contradictions_are_balanced(spark):
    rows = [(i, 0, 1) for i in range(7)] + [(i, 1, 1) for i in range(10, 13)] + [(20, 1, 0), (21, None, 1), (22, 1, None)]
    df = spark.createDataFrame(rows, "key int, label int, wrong int")
    out = evidence.balanced_contradictions(df, "key", "wrong").collect()
    kinds = [r["variant"] for r in out]
    assert kinds.count("ordinary_error") == kinds.count("deception") == 3 and {r["key"] for r in out if r["variant"] == "deception"} == {10, 11, 12}
    assert evidence.balanced_contradictions(df.filter("label = 0"), "key", "wrong").count() == 0


def test_synthetic_candidates_of_a_hot_predicate(spark):
    facts = [(f"e{i}", "hot", f"v{i % 7}") for i in range(300)] + [(f"e{i}", p, f"{p}{i}") for i in range(40) for p in ("b", "c", "d")]
    facts += [("e1", "hot", "v9"), ("e1", "hot", "v9"), (None, "hot", "x"), ("e2", None, "x"), ("e3", "alone", "y"), ("e4", "b", None)]
    known = {f for f in facts if None not in f}
    rows = knowledge.synthetic_candidates(spark.createDataFrame(facts, "entity string, predicate string, value string")).collect()
    anchors = {}
    for r in rows:
        anchors.setdefault((r["entity"], r["predicate"]), []).append(r)
    assert set(anchors) == {f[:2] for f in known}
    for (entity, predicate), found in anchors.items():
        found.sort(key=lambda r: r["place"])
        others = len({f[1] for f in known if f[0] == entity}) - 1
        kinds = [r["kind"] for r in found]
        assert [r["place"] for r in found] == list(range(len(found))) and len(found) <= 8
        assert kinds[0] == "anchor" and kinds.count("anchor") == 1 and kinds.count("relevant_insufficient") == min(2, others)
        assert len({(r["c_entity"], r["c_predicate"]) for r in found}) == len(found)
        assert all((r["c_entity"], r["c_predicate"], r["c_value"]) in known for r in found)
        for r in found[1:]:
            assert (r["c_entity"] == entity) == (r["kind"] == "relevant_insufficient") and (r["c_entity"], r["c_predicate"]) != (entity, predicate)
        same = [r for r in found if r["c_predicate"] == predicate and r["kind"] == "irrelevant"]
        assert len(same) == (0 if predicate == "alone" else 2)


def test_scenario_floors_refuse_a_blend_that_hurts_one(spark):
    """y orders scenario b wrongly and a, c rightly; x knows nothing. The unit gains as a whole, scenario b loses."""
    rows = []
    for s, sign in (("a", 1), ("b", -1), ("c", 1)):
        for i in range(20):
            label = i % 2
            rows.append(("f", "u", s, label, 0.5 + 0.001 * label * (s == "b"), 0.5 + sign * (0.3 if label else -0.3)))
    df = spark.createDataFrame(rows, "family string, unit string, scenario string, label int, x double, y double")
    choose = lambda **more: learning.select_parameters(df, "family", "unit", "x", "y", [0.5], 0.0, 0.5, -0.2, **more).first()
    assert choose()["weight"] == 0.5
    assert choose(scenario="scenario", floor=-0.1)["weight"] == 0.0 and choose(scenario="scenario", floor=-1.0)["weight"] == 0.5


def test_best_grid_row_by_four_keys(spark):
    rows = [(0.1, 0.8, 0.7, 0.2), (0.2, 0.8, 0.9, 0.3), (0.3, 0.8, 0.9, 0.1), (0.4, 0.8, 0.9, 0.1), (0.5, None, 1.0, 0.0)]
    grid = spark.createDataFrame(rows, "c double, balanced_accuracy double, auroc double, fpr double")
    assert learning.grid_select(grid, learning.best_first("c")).first()["c"] == 0.3
