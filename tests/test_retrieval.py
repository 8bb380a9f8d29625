from assaykit.operators import retrieval

SCHEMA = "k long, x string"


def test_containment_matches_brute_force(spark):
    long_ = " ".join(f"w{i}" for i in range(30))
    refs = [long_, "alpha beta\ngamma delta", "one two", "solo", None, "", "a b c", "Cat sat on", "p \v q r"]
    docs = ["before " + long_.replace(" ", "\n", 3) + " after", "x ALPHA beta gamma  deltas", "alpha beta\nnothing\ngamma delta", "w3 w4 w5", "w", "someone twofold", "isolos", None, " ", "bobcat sat once", "one", long_, "za b cz", "op q rs"]
    got = retrieval.text_containment(spark.createDataFrame(list(enumerate(docs)), SCHEMA).toDF("d", "x"), spark.createDataFrame(list(enumerate(refs)), SCHEMA).toDF("r", "x"), "d", "x", "r", "x")
    flat = lambda xs: [" ".join((x or "").lower().split()) for x in xs]
    want = {(i, j) for i, r in enumerate(flat(refs)) for j, d in enumerate(flat(docs)) if r and d and (r in d or d in r)}
    rows = [(x["r"], x["d"]) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {(0, 0), (1, 1), (0, 3), (2, 5), (3, 6), (7, 9), (6, 12)} <= want


def test_long_lines_give_their_sentences(spark):
    parts = [f"Sentence {i} of a long line has 3.14 words, e.g. about this\nmany." for i in range(20)]
    text = " ".join(parts + ["Short one.", parts[4].replace("Sentence", "SENTENCE"), "X" * 901 + ".", "(A last sentence in parentheses, kept whole)"])
    got = retrieval.page_sentences(spark.createDataFrame([(1, text), (2, None), (3, "")], SCHEMA), "k", "x").orderBy("place").collect()
    want = [(i, p.replace("\n", " ")) for i, p in enumerate(parts)] + [(22, "(A last sentence in parentheses, kept whole)")]
    assert [(r["place"], r["sentence"]) for r in got] == want
