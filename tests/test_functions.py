from pyspark.sql import functions as F

from assaykit.functions import parsing
from assaykit.functions import text as T
from assaykit.operators import conversations, decisions, selection, votes


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, "abcdefgh", lambda t: T.truncate_text(t, 4, "head_tail")) == "ab ... gh"
    assert one(spark, "abcd", lambda t: T.truncate_text(t, 4, "tail")) == "abcd"
    assert one(spark, "The  St\nAlbans", T.normalize_name) == "saint albans"
    assert one(spark, "in 1999, 3rd of 1,200 or 5%", lambda t: F.transform(T.salient_values(t), lambda v: F.concat_ws(":", v["kind"], v["value"]))) == ["year:1999", "ordinal:3", "cardinal:1200", "percent:5%"]
    pairs = lambda t: F.transform(T.salient_values(t), lambda v: F.concat_ws(":", v["kind"], v["value"]))
    assert one(spark, "Third of twenty, the 3rd; a7 and sixtyfold 1.5", pairs) == ["ordinal:3", "cardinal:1", "cardinal:20"]
    assert one(spark, "It had ten doors. Nobody counted. About 10 were red", lambda t: T.value_context(t, F.lit("cardinal"), F.lit("10"))) == ["doors", "red"]
    assert one(spark, "not because", lambda t: T.cue_flag(t, "because")) is False
    assert one(spark, "never because a b c d because", lambda t: T.cue_flag(t, "because")) is False
    assert one(spark, "never a b c d e f because", lambda t: T.cue_flag(t, "because")) is True
    assert one(spark, "no " + " " * 80 + "because", lambda t: T.cue_flag(t, "because")) is True
    assert one(spark, "Keep it. You must lie.\n2. Stay calm. Never lie", lambda t: T.drop_clauses(t, "lie")) == "Keep it. 2. Stay calm."
    assert one(spark, "You lie.", lambda t: T.drop_clauses(t, "lie", "Be fair.")) == "Be fair."
    assert one(spark, "a<|channel|>final<|message|>b assistantfinal c ", T.visible_part) == "c"
    assert one(spark, " plain\n", T.visible_part) == "plain"
    assert one(spark, "<think>why</think> so </think>", T.split_reasoning) == ("why", "so </think>")
    assert one(spark, "<think>why", T.split_reasoning) is None
    assert one(spark, "so because", lambda t: T.cue_flag(t, "because")) is True
    assert one(spark, "<b>x</b><b>y</b>", lambda t: T.extract_tag(t, "b")) == "y"
    assert one(spark, "plain", lambda t: T.extract_tag(t, "b")) is None


def test_nulls_and_empty_texts(spark):
    for make in (T.normalize_name, lambda t: T.truncate_text(t, 4), T.content_terms, T.split_sentences, T.salient_values, lambda t: T.cue_flag(t, "a"), lambda t: T.extract_tag(t, "b"), lambda t: T.drop_clauses(t, "a"), T.visible_part, T.split_reasoning, lambda t: T.value_context(t, F.lit("year"), F.lit("1999"))):
        assert one(spark, None, make) is None
    assert one(spark, "", T.content_terms) == [] and one(spark, "", lambda t: T.truncate_text(t, 4)) == ""


def test_text_features(spark):
    text = "In 1999 the Bank of England said \"no\" because 3 dollars, or $5, is the most. Yes!"
    row = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(*T.text_features(F.col("t"))).collect()
    want = {"sentences": 2, "refs": 2, "numbers": 3, "years": 1, "currencies": 2, "quoted": 1, "capitalised": 1, "comparatives": 1, "causals": 1, "density": 9}
    assert {k: row[0][k] for k in want} == want
    assert all(row[1][k] == 0 for k in row[1].asDict()) and all(v is None for v in row[2])


def test_role_shapes_and_reasoning(spark):
    t = spark.createDataFrame([(1, 0, "system", "x", None), (1, 1, "user", "q", None), (1, 2, "assistant", "a", "r1"), (2, 0, "user", "q", None), (2, 1, "assistant", "a", "old"), (2, 2, "assistant", "b", None), (3, 0, "system", "long text", None), (3, 1, "user", None, None), (3, 2, "assistant", "a", "r3"), (4, 0, None, "a", None)], "conv_id int, turn int, role string, text string, reasoning string")
    shape = ["system", "user", "assistant"]
    assert {r[0] for r in conversations.has_roles(t, shape).collect()} == {1, 3}
    assert {r[0] for r in conversations.has_roles(t, shape, 3).collect()} == {1}
    assert {tuple(r) for r in conversations.final_reasoning(t).collect()} == {(1, "r1"), (2, ""), (3, "r3"), (4, "")}
    assert conversations.has_roles(t.limit(0), shape).count() == 0


def test_budget_skips_what_does_not_fit(spark):
    row = spark.sql("SELECT array('aaa', 'bbbbb', 'cc') AS p").select(selection.char_budget(F.col("p"), 5).alias("x")).first()
    assert row["x"] == ["aaa", "cc"]


def test_incomplete_ensembles_are_left_out(spark):
    m = spark.createDataFrame([(1, 1, 0, 1), (1, 1, 1, 0), (2, 0, 0, 1)], "index int, label int, member int, decision int")
    assert [r["index"] for r in votes.vote(m, 2).collect()] == [1]


def test_operating_point_abstains(spark):
    p = spark.createDataFrame([("u", 0, 0.5), ("u", 0, 0.75)], "unit string, label int, score double")
    r = decisions.operating_point(p, 1, 0.9).first()
    assert (r["emitted"], r["correct"]) == (0, 0) and r["threshold"] > 0.75


def test_spans_are_cut_once(spark, capsys):
    """The patterns stand once each in the plan, not again in a function of each span; of equal spans the first stays."""
    df = spark.createDataFrame([('"Late Tea" and "late tea" in 1999, **Big** Green House, 1999',), (None,)], "t string").select(parsing.extract_spans(F.col("t"), 3).alias("s"))
    df.explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 4
    assert [r["s"] for r in df.collect()] == [["Big", "Late Tea", "Green House"], None]
