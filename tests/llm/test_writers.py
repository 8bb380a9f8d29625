"""Written shards and mixes, words before a row in a crowded block, components, and scores of plain walks."""

import collections
import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from assaykit.llm import graph, mixing, quality, queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out string"
DATA = "/root/testdata/sf0.001"


def table(spark, n=60):
    rows = [(i, None if i % 13 == 0 else " ".join(f"w{k}" for k in range(i % 9)), "en", None if i % 7 == 0 else f"s{i % 3}", 0, "x", "y") for i in range(n)]
    return spark.createDataFrame(rows + rows[:5], SCHEMA)


def test_words_before_a_row_in_a_block_of_any_size(spark):
    rng = random.Random(3)
    rows = [(s, rng.randint(-(2**62), 2**62), i, rng.randint(0, 50)) for s in range(2) for i in range(1500)]
    rows += [(0, 77, 9000 + i, 3) for i in range(200)] + [(1, 5, None, 4)]
    got = mixing.words_before(spark.createDataFrame(rows, "__s int, __h long, doc_id long, size long")).collect()
    total, want = collections.Counter(), {}
    for s, h, i, n in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0)):
        want[s, h, i] = total[s]
        total[s] += n
    assert {(r["__s"], r["__h"], r["doc_id"]): r["__u"] for r in got} == want and len(got) == len(rows)


def test_written_shards_hold_all_rows_in_slot_order(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/shards"
    df = table(spark)
    sharding.write_shards(df, path, 4)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    places = collections.defaultdict(list)
    for r in back.select("shard", "slot").collect():
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and max(map(len, places.values())) - min(map(len, places.values())) <= 1


def test_written_mix_equals_the_mix(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/mix"
    mix = mixing.mix_sources(table(spark), n_shards=3)
    mixing.write_mix(mix, path)
    back = spark.read.parquet(path).select(*mix.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, mix.collect())) and back.count() > 0


def test_components_of_links_with_nulls_and_a_hub(spark):
    links = [(1, 2), (2, 3), (3, 3), (None, 4), (5, None), (9, 8), (8, 7)] + [(100, 101 + i) for i in range(500)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(501)}
    assert graph.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_scores_decide_at_their_cuts_and_ignore_clashing_columns(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.withColumn("score", F.lit("x")).withColumn("held_out", F.lit("y")).withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    for name, cut in (("op4_quality_trees", 0.5), ("op5_toxicity_convolution", 0.7)):
        plain = {r["doc_id"]: r for r in queries.queries()[name](spark, DATA).collect()}
        clashing = {r["doc_id"]: r for r in queries.queries()[name](spark, path).collect()}
        assert len(plain) == docs.count() and all(r["predicted"] == int(r["score"] >= cut) and 0 <= r["score"] <= 1 for r in plain.values())
        assert all(np.isclose(clashing[i]["score"], r["score"], atol=1e-9) for i, r in plain.items())


def test_flat_trees_equal_a_walk(spark):
    """Scores of the flattened arrays, against one row and one node at a time."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] * x[:, 1] > 0).astype(float)
    model = quality.BoostedTrees().fit(x, y)
    one = np.array([model.predict(x[i : i + 1])[0] for i in range(50)])
    assert np.allclose(one, model.predict(x)[:50]) and ((model.predict(x) >= 0.5) == y).mean() > 0.95
