"""Spans, qualifiers and narrowed relations of questions and answers; views of dialogues; reuse of parsed entries."""

import re

from pyspark.sql import functions as F

from assaykit.functions import claims as C
from assaykit.operators import audits, conversations

MARKED = re.compile(r"\*\*[^*]{2,120}\*\*|(?<!\*)\*[^*]{2,120}\*(?!\*)|[\"“][^\"”]{2,120}[\"”]|(?<!\w)'[^'\n]{3,120}'(?!\w)")
TEXTS = [
    'In *Les Mis* and **The Wall**, "a line" or “another”, not \'single one\' nor don\'t and can\'t',
    "***x*** *a* **b** *ab* **abc*** *abcd**",
    "Who was the Duke of York and of the North Sea? Mary Ann O'Neil, England, said X of Al",
    "", "no spans here", "a" * 130 + ' "' + "b" * 121 + '" "ok then"',
]


def rows(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def strip(span):
    return re.sub(r"""^(?:\*\*|[*"“'])|(?:\*\*|[*"”'])$""", "", span).strip(" .,:;!?()[]")


def test_marked_spans_equal_those_of_a_plain_search(spark):
    assert rows(spark, TEXTS, C.marked_spans) == [[strip(m.group(0)) for m in MARKED.finditer(t)] for t in TEXTS]


def test_proper_spans(spark):
    got = rows(spark, TEXTS, C.proper_spans)
    assert got[2] == ["Duke of York and of the North Sea", "Mary Ann O'Neil", "X of Al"]
    assert got[3:5] == [[], []]


def test_unique_spans_by_key_and_limit(spark):
    make = lambda t: C.unique_spans(F.split(t, ";"), 3)
    assert rows(spark, ["A b;a  B!;?;c;d;e", "", None], make) == [["A b", "c", "d"], [], None]


def test_qualifiers(spark):
    assert rows(spark, ["Not the FIRST of 1999, not 2001 or 20010, lastly", None], C.qualifiers) == [["1999", "2001", "Not", "FIRST"], None]


def test_claims_are_narrowed_group_by_group(spark):
    relations = [("place", r"\bwhere\b", ["country", "city"]), ("time", r"\bwhen\b", ["birth", "death"])]
    groups = [(["country", "city"], [(r"\bcity\b", ["city"]), (r"\bplace\b", ["spot", "city"])], True), (["birth", "death"], [(r"\bborn\b", ["birth"]), (r"\bdied\b", ["death"])], False)]
    df = spark.createDataFrame([(1, "Where in the city or place, and when was Ann Lee born or died?", "In **Rome**. Two. Three. In Paris."), (2, "Where?", None), (3, None, None), (4, "When did it end?", "")], "i int, q string, a string")
    got = {r["i"]: r["x"] for r in df.select("i", C.extract_claim(F.col("q"), F.col("a"), relations, groups).alias("x")).collect()}
    assert got[1]["predicates"] == ["city", "spot", "birth"] and got[1]["relations"] == ["place", "time"]
    assert got[1]["subjects"] == ["Ann Lee"] and got[1]["values"] == ["Rome", "Two", "Three"]
    assert got[2]["predicates"] == ["country", "city"] and got[4]["predicates"] == ["birth", "death"]
    assert all(len(v) == 0 for v in got[3])


def test_text_views_leave_out_the_final_answer(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a1"), (1, 3, "user", "r"), (1, 4, "assistant", "a2"), (1, 5, "user", "late"), (2, 0, "user", None)], "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: r for r in conversations.text_views(t, 100).collect()}
    assert got[1]["output"] == "a2" and got[1]["context"] == "SYSTEM: s\n\nUSER: q\n\nASSISTANT: a1\n\nUSER: r" and got[1]["both"].endswith("USER: r\n\na2")
    assert (got[2]["output"], got[2]["context"], got[2]["both"]) == ("", "USER: ", "USER: ")
    short = conversations.text_views(t, 7, ["user"]).filter("conv_id = 1").first()
    assert short["context"] == "... USER: r"
    assert conversations.text_views(t.limit(0), 7).count() == 0


def test_reuse_asks_for_parsed_entries_and_evidence(spark):
    work = spark.createDataFrame([(1, "a", "e"), (2, "b", "e"), (3, "c", " "), (4, "d", None), (5, "x", "e")], "k int, text string, evidence string")
    cache = work.select("k", F.sha2(F.when(F.col("k") == 5, "old").otherwise(F.col("text")), 256).alias("hash"), (F.col("k") * 10).alias("v"), (F.col("k") != 2).cast("int").alias("parsed"))
    empty = spark.createDataFrame([(3, -3)], "k int, v int")
    out = audits.reuse_or_compute(work, cache, "k", ["text"], "v", F.lit(0), "parsed", "evidence", empty)
    assert sorted((r["k"], r["reused"], r["v"]) for r in out.collect()) == [(1, 1, 10), (2, 0, 0), (3, 2, -3), (4, 1, 40), (5, 0, 0)]
