"""Operators with state: the cases of fixed windows, registries and boards, on tables and on streams."""

import tempfile
import time

import numpy as np
import pytest

from assaykit.streaming import state

EVENTS = [("a", str(i), t) for i, t in enumerate([1000.0, 1001.0, 1002.0, 1003.0, 1099.0, 1101.0, 1102.0, 1103.5, 1104.0, 1300.0])] + [("dev", "x", 5.0), ("dev", "y", 6.0), ("b", "z", 1003.0)]
SCHEMA = "key string, event string, at double"


def rows(df):
    return {(r["key"], r["event"]): (r["allowed"], r["retry_after"]) for r in df.collect()}


def test_windows_open_at_the_first_event(spark):
    got = rows(state.rate_limit(spark.createDataFrame(EVENTS, SCHEMA), 3, 100, ("dev",)))
    assert [got["a", str(i)][0] for i in range(10)] == [True] * 3 + [False, False] + [True] * 3 + [False, True]
    assert got["a", "3"][1] == int(1000 + 100 - 1003) + 1 and got["a", "4"][1] == 2 and got["a", "8"][1] == 98
    assert got["b", "z"] == (True, 0) and got["dev", "y"] == (True, 0)
    one = rows(state.rate_limit(spark.createDataFrame(EVENTS, SCHEMA), 1, 100, ("dev",)))
    assert one["a", "1"][0] is False and one["dev", "y"][0] is True
    assert all(ok for ok, _ in rows(state.rate_limit(spark.createDataFrame(EVENTS, SCHEMA), 0, 100)).values())
    assert not rows(state.rate_limit(spark.createDataFrame([], SCHEMA), 3, 100))


def test_many_events_of_one_key_are_limited_in_time(spark):
    """80,000 events of a key, whose windows were each looked for among all later events: that took minutes."""
    rng = np.random.default_rng(3)
    events = [("a", str(i), float(t)) for i, t in enumerate(np.round(rng.uniform(0, 1000, 80_000), 3))] + [("b", str(i), 7.3 * i * i) for i in range(40)]
    began = time.time()
    got = rows(state.rate_limit(spark.createDataFrame(events, SCHEMA), 3, 43.7))
    assert time.time() - began < 60
    for key in "ab":
        own = sorted((t, e) for k, e, t in events if k == key)
        allowed, retry, _, _ = state._consume([t for t, _ in own], None, 0, 3, 43.7)
        assert [got[key, e] for _, e in own] == list(zip(allowed, retry, strict=True))


def feed(spark, folder, parts, schema):
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_a_stream_limits_as_the_table(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    order = sorted(EVENTS, key=lambda e: e[2])
    stream = state.stream_rate_limit(feed(spark, folder, [order[:5], order[5:9], order[9:]], SCHEMA), 3, 100, ("dev",))
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.read.parquet(f"{folder}/out")) == rows(state.rate_limit(spark.createDataFrame(EVENTS, SCHEMA), 3, 100, ("dev",)))


REQUESTS = [("k1", " red ", 1), ("k1", "blue", 2), ("k2", "red", 3), ("k3", "  ", 4), ("k3", "green", 5), ("k4", None, 6)]


def test_names_are_bound_once(spark):
    schema = "key string, name string, at long"
    got = {r["name"] for r in state.registry(spark.createDataFrame(REQUESTS, schema)).collect()}
    assert got == {"red", "green"}
    folder = tempfile.mkdtemp(prefix="spark-")
    merge = lambda batch, known: state.registry(batch, known)
    q = feed(spark, folder, [REQUESTS[:1], REQUESTS[1:3], REQUESTS[3:]], schema).writeStream.foreachBatch(state.versioned(f"{folder}/reg", merge)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in state.registry(spark.createDataFrame(REQUESTS, schema)).select("key_hash", "name").collect()}
    assert {tuple(r) for r in state.latest(spark, f"{folder}/reg").select("key_hash", "name").collect()} == want


def test_the_live_board_is_that_of_the_table(spark):
    schema = "team long, notebook string, metric double, at string"
    data = [(1, "n", 0.5, "a"), (1, "n", 0.7, "b"), (1, "n", 0.7, "c"), (2, "n", None, "a"), (2, "m", 0.1, "d")]
    folder = tempfile.mkdtemp(prefix="spark-")
    q = feed(spark, folder, [data[:2], data[2:]], schema).writeStream.foreachBatch(state.versioned(f"{folder}/board", state.best_submissions)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    board = {tuple(r) for r in state.latest(spark, f"{folder}/board").collect()}
    assert board == {(1, "n", 0.7, "b"), (2, "m", 0.1, "d")} == {tuple(r) for r in state.best_submissions(spark.createDataFrame(data, schema)).collect()}


def test_a_ledger_stream_drops_what_is_no_record(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    lines = ['{"team": 1, "metric": 0.5}', '{"team": ', "3", '{"team": 2}', '{"team": "x"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{folder}/in")
    q = state.stream_results(spark, f"{folder}/in", "team long, metric double").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()} == {(1, 0.5), (2, None)}


def test_scoring_resumes(spark):
    from pyspark.sql import functions as F

    work = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    done = spark.createDataFrame([(1, 9)], "k long, score long")
    assert {tuple(r) for r in state.resume_scoring(work, done, "k", F.col("k") * 2).collect()} == {(1, 9), (2, 4)}
    with pytest.raises(ValueError):
        state.resume_scoring(work, done.unionByName(done), "k", F.col("k"))
