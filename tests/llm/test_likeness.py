"""Likeness of long texts, and its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from assaykit.llm import fingerprints as fp
from assaykit.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


def near(spark, a, b):
    v = lambda c: fp.leveled_vector(fp.line_hashes(F.col(c)))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(v("a").alias("a"), v("b").alias("b"))
    df = df.select("a", "b", fp.equal_lanes(F.col("a"), F.col("b")).alias("same"))
    return df.select(fp.leveled_likeness(F.col("a"), F.col("b"), F.col("same")).alias("x")).first()["x"]


@pytest.mark.parametrize("n", [10, 400, 1000, 5000])
def test_likeness_holds_at_every_length(spark, n):
    text = lambda name, lo, hi: [f"{name} {i}" for i in range(lo, hi)]
    own = text("own", 0, n)
    assert near(spark, "\n".join(own), "\n".join(text("other", 0, n))) < 0.4
    edited = own[: n - n // 4] + text("other", 0, n // 4)
    assert abs(near(spark, "\n".join(own), "\n".join(edited)) - 0.75) < 0.15
    assert near(spark, "\n".join(own), "\n".join(reversed(own))) == 1


def test_lines_that_repeat_count(spark):
    assert near(spark, "\n".join(["x"] * 400), "x") < 0.01


def test_leveled_vectors_add(spark):
    v = lambda s: fp.leveled_vector(fp.line_hashes(F.lit(s)))
    r = spark.range(1).select(v("a\nb").alias("ab"), v("a").alias("a"), v("b").alias("b"))
    r = r.select(fp.add(F.col("a"), F.col("b"), fp.level_moduli()).alias("s"), "ab", fp.remove(F.col("ab"), F.col("a"), fp.level_moduli()).alias("d"), "b").first()
    assert r["s"] == r["ab"] and r["d"] == r["b"]


def test_likeness_matches_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    theirs = {r[0]: r[1:] for r in c.execute(oracle_sql()["op3_line_likeness"]).fetchall()}
    ours = {r[0]: tuple(r)[1:] for r in queries()["op3_line_likeness"](spark, DATA).collect()}
    assert ours.keys() == theirs.keys()
    assert all(ours[k] == pytest.approx(tuple(map(float, theirs[k])), abs=1e-9) for k in ours)
