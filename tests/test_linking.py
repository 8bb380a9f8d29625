"""Entity links against all pairs, where one word stands in every name."""

import collections
import re

import numpy as np

from assaykit.operators import relations


def plain(claims, entities, least=70.0, margin=3.0):
    clean = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()
    out = []
    for c, mention in claims:
        best = {}
        for e, name in entities:
            a, b = clean(mention), clean(name)
            if a and b:
                s = (a == b, 100.0 if a == b else 20.0 + 10 * len(set(a.split()) & set(b.split())))
                if s[1] >= least:
                    best[e] = max(best.get(e, (False, 0)), s)
        ranked = sorted((-s[1], e) for e, s in best.items())
        if ranked and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= margin):
            out.append((c, ranked[0][1], -ranked[0][0]))
    return sorted(out)


def test_rare_words_find_all_links(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"n{k}" for k in range(60)]
    entities = [(int(rng.integers(0, 80)), "The " + " ".join(rng.choice(vocabulary, int(rng.integers(1, 9)), replace=False))) for _ in range(150)]
    claims = [(i, entities[int(rng.integers(0, 150))][1] + rng.choice(["", " x", " n1 n2", "!"])) for i in range(200)] + [(900, None), (901, ""), (902, "the")]
    df = [spark.createDataFrame(claims, "claim long, mention string"), spark.createDataFrame(entities + [(99, None), (98, "")], "entity long, name string")]
    assert sorted(tuple(r) for r in relations.link_entities(*df).collect()) == plain(claims, entities)
    pairs = relations._shared_words(df[0].selectExpr("trim(regexp_replace(lower(mention), '[^a-z0-9]+', ' ')) AS m").filter("m <> ''"), df[1].selectExpr("trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ')) AS m").filter("m <> ''"), 5)
    assert pairs.filter("n < 5").count() == 0 and collections.Counter((r["a"], r["b"]) for r in pairs.collect()).most_common(1)[0][1] == 1


def test_aliases_hints_and_context(spark):
    entities = spark.createDataFrame([(1, "Big Ben", "a clock in london"), (1, "Great Bell", "a clock in london"), (2, "big ben", "a film of 1950"), (3, "Mercury", "planet sun"), (4, "Mercury", "metal element")], "entity long, name string, about string")
    rows = [(1, "great bell", "which clock?", ""), (2, "Big Ben", "which film has it?", ""), (3, "mercury", "which planet near the sun", ""), (4, "mercury", "what", ""), (5, "mercury", "what", "metal")]
    claims = spark.createDataFrame(rows, "claim long, mention string, question string, values string")
    got = {r["claim"]: (r["entity"], r["score"]) for r in relations.link_entities(claims, entities, hints=[("film", ["film"])]).collect()}
    assert got == {1: (1, 100.0), 2: (2, 100.0), 3: (3, 100.0), 5: (4, 100.0)}


def test_texts_do_not_go_with_each_of_their_words(spark):
    """A mention of 3,000 words was sent once for each of them."""
    long = " ".join(f"w{k}" for k in range(3000))
    claims = spark.createDataFrame([(i, f"{long} x{i}") for i in range(20)], "claim long, mention string")
    entities = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 y"), (2, "w1 w2 w3 w4 z")], "entity long, name string")
    pairs = relations._shared_words(claims.selectExpr("mention AS m"), entities.selectExpr("name AS m"), 5)
    assert sorted(r["n"] for r in pairs.collect()) == [5] * 20 and max(len(r["a"]) for r in pairs.collect()) == 16
    assert relations.link_entities(claims, entities).filter("entity = 1 AND score = 70").count() == 20
