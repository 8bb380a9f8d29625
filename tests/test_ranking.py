"""The hashed ranker on questions whose right candidate is known."""

import numpy as np

from assaykit.operators import ranking

SCHEMA = "q long, c long, label int, features array<struct<name: string, value: double>>"


def rows(n=150, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for q in range(n):
        right = int(rng.integers(0, 6))
        for c in range(6):
            match = float(c == right) * 0.8 + float(rng.random()) * 0.5
            out.append((q, q * 10 + c, int(c == right), [("match", match), (f"word={int(rng.integers(0, 40))}", 1.0)]))
    return out


def test_right_candidates_come_first(spark):
    df = spark.createDataFrame(rows() + [(900, 1, 0, []), (None, 1, 1, []), (901, None, 1, []), (902, 2, 1, None)], SCHEMA)
    out, threshold = ranking.fit_ranker(df, "q", "c")
    report = {r["side"]: r for r in ranking.ranking_report(out, "q", 3, threshold).collect()}
    assert set(report) == {"fit", "calibrate", "test"} and sum(r["questions"] for r in report.values()) == 152
    assert report["test"]["top_1"] >= 0.9 and report["test"]["top_k"] >= report["test"]["top_1"]
    said = report["calibrate"]
    assert said["emitted"] >= 5 and said["right"] / said["emitted"] >= 0.8
    places = {(r["q"], r["c"]): (r["place"], r["score"]) for r in out.collect()}
    assert all(sorted(places[q, q * 10 + c][0] for c in range(6)) == [1, 2, 3, 4, 5, 6] for q in range(150))
    again, same = ranking.fit_ranker(df.repartition(7), "q", "c")
    assert abs(same - threshold) < 1e-6 and {(r["q"], r["c"]): r["place"] for r in again.filter("score <> 0").collect()}


def test_pairs_stay_within_a_question_and_its_bound(spark):
    many = [(1, c, int(c < 3), [("f", float(c))]) for c in range(200)] + [(2, 1, 1, [("f", 1.0)])]
    df = spark.createDataFrame(many, SCHEMA).selectExpr("*", "'fit' AS side")
    pairs = ranking._pairs(df, "q", "c", "s").collect()
    assert len(pairs) == 3 * ranking.NEGATIVES and {r["q"] for r in pairs} == {1}


def test_without_a_pair_all_scores_are_nought(spark):
    df = spark.createDataFrame([(1, 1, 1, [("a", 1.0)]), (2, 2, 1, [("b", 1.0)])], SCHEMA)
    out, threshold = ranking.fit_ranker(df, "q", "c")
    assert {r["score"] for r in out.collect()} == {0.0} and threshold > 0
    assert ranking.fit_ranker(df.limit(0), "q", "c")[0].collect() == []
