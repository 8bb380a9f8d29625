"""Links of mentions that tasks find by themselves, against the joins that large tables of names take."""

import numpy as np
import pytest

from assaykit.operators import relations


def made(spark, seed, twice):
    rng = np.random.default_rng(seed)
    words = [f"n{k}" for k in range(40)] + ["The", "of"]
    some = lambda least, most: " ".join(rng.choice(words, int(rng.integers(least, most)), replace=False))
    entities = [(int(rng.integers(0, 40)) if rng.random() > 0.05 else None, rng.choice([some(1, 14), "", "Big, Ben"]), rng.choice([some(5, 20) + " th", some(5, 20) + " 1950", ""]) if rng.random() > 0.1 else None) for _ in range(120)]
    names = [n for _, n, _ in entities]
    mention = lambda: rng.choice([some(3, 30), str(rng.choice(names)), str(rng.choice(names)) + "!"])
    claims = [(i, mention(), rng.choice([some(5, 30), "which film 7 " + some(3, 9)]) if rng.random() > 0.1 else None, rng.choice(["en", "n3 n4 n5", ""])) for i in range(150)]
    claims += [(None, mention(), "x", ""), (400, None, "x", ""), (401, "--", "x", "")]
    if twice:
        claims += [(i, mention(), "which 9 " + some(3, 9), "") for i in range(0, 150, 7)]
    return spark.createDataFrame([tuple(map(lambda x: str(x) if isinstance(x, np.str_) else x, r)) for r in claims], "claim long, mention string, question string, values string"), spark.createDataFrame(
        [tuple(map(lambda x: str(x) if isinstance(x, np.str_) else x, r)) for r in entities], "entity long, name string, about string"
    )


@pytest.mark.parametrize("limit", [1, 3])
def test_a_scan_gives_the_links_of_joins(spark, monkeypatch, limit):
    claims, entities = made(spark, limit, False)
    hints = [("[0-9]", ["th", "en"]), ("film", ["1950"])]
    asked = lambda: [sorted(map(tuple, relations.link_entities(c, entities, limit=limit, hints=hints).collect()), key=str) for c in (claims, claims.drop("question"))]
    monkeypatch.setattr(relations, "CELLS_A_STEP", 1000)
    with_scan = asked()
    monkeypatch.setattr(relations, "MOST_IN_TASKS", 0)
    assert with_scan == asked() and all(len(x) > 20 for x in with_scan)


def test_claims_that_come_twice_are_one(spark):
    """The best of a claim's mentions counts, whichever row has it."""
    claims, entities = made(spark, 5, True)
    found = [(r["claim"], r["entity"], r["score"]) for r in relations.link_entities(claims.drop("question"), entities).collect()]
    one = {c: s for c, _, s in found}
    each = relations.link_entities(claims.drop("question").selectExpr("monotonically_increasing_id() AS claim", "mention", "claim AS own"), entities)
    assert len(found) == len(one) and len(one) > 20 and not each.filter("score < 70").count()


def test_texts_and_pairs_are_not_shuffled(spark, monkeypatch):
    """Each pair of a claim and an entity that share words was joined to the words of both and to the claim's whole text."""
    monkeypatch.setattr(relations, "_shared_words", lambda *a: pytest.fail("joined"))
    claims = spark.createDataFrame([(i, "a b c d e f", "a question 7", "") for i in range(300)], "claim long, mention string, question string, values string")
    entities = spark.createDataFrame([(i, f"a b c d e g{i}", f"about g{i} th") for i in range(50)] + [(99, "a b c d e f", "question th")], "entity long, name string, about string")
    out = relations.link_entities(claims, entities, hints=[("[0-9]", ["th"])])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r)[1:] for r in out.collect()} == {(99, 100.0)} and out.count() == 300
