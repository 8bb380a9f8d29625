"""Operators with state: ledger ingest, rate limits, a registry, a live leaderboard, scoring that resumes.

Each has a form for tables and one for streams; a stream that has seen a table gives the table's result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.arrowtext import cut
from ..sources.scans import _parsed


def stream_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ledger as a stream; lines that are no records of the schema are dropped."""
    return _parsed(spark.readStream.text(path), schema).filter("_corrupt IS NULL").select("r.*").drop("_corrupt")


def _consume(times, start: float | None, used: int, most: int, seconds: float):
    """Decisions of one key's times in their order, and the window that stays open."""
    allowed, retry = [], []
    for t in times:
        if start is None or t >= start + seconds:
            start, used = t, 0
        if used < most:
            used += 1
            allowed.append(True)
            retry.append(0)
        else:
            allowed.append(False)
            retry.append(max(1, int(start + seconds - t) + 1))
    return allowed, retry, start, used


_LIMIT_SCHEMA = "key string, event string, at double, allowed boolean, retry_after int"


def rate_limit(events: DataFrame, most: int, seconds: float, exempt: tuple[str, ...] = ()) -> DataFrame:
    """``key, event, at, allowed, retry_after`` of ``events (key, event, at)``: a key's first event opens a window of so many seconds, which takes ``most``.

    Exempt keys and limits of 0 let all pass. Order is by time, then event. Windows depend on all earlier ones of their key, so they
    are found by following, for each key, the first event after the window; only window starts are followed, and each
    event is then counted within its own window. Times are dealt to slots as long as a window, so that a task orders one slot of a key;
    what lies in later or earlier slots is known from one row a slot.
    """
    e = events.select(F.col("key").cast("string"), F.col("event").cast("string"), F.col("at").cast("double"))
    if most <= 0 or seconds <= 0:
        return e.select("*", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"))
    free = F.col("key").isin(*exempt) if exempt else F.lit(False)
    slot = lambda c: F.floor(F.col(c) / seconds)
    limited = e.filter(~F.coalesce(free, F.lit(False))).withColumn("slot", slot("at"))
    times = cut(limited.filter("key IS NOT NULL AND at IS NOT NULL").select("key", "at").distinct())
    ends = times.select("key", "at", (F.col("at") + seconds).alias("x"), F.lit(True).alias("end"))
    marks = times.select("key", "at", F.col("at").alias("x"), F.lit(False).alias("end"))
    both = marks.unionByName(ends).withColumn("slot", slot("x"))
    # From the last one on, an end has passed the times that are not before it.
    passed = Window.partitionBy("key", "slot").orderBy(F.desc("x"), "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("near", F.min(F.when(~F.col("end"), F.col("x"))).over(passed)).filter("end").select("key", "at", "slot", "near")
    behind = Window.partitionBy("key").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)  # one row a slot
    later = both.groupBy("key", "slot").agg(F.min(F.when(~F.col("end"), F.col("x"))).alias("first")).withColumn("later", F.min("first").over(behind)).drop("first")
    steps = cut(near.join(later, ["key", "slot"]).select("key", "at", F.coalesce("near", "later").alias("next")))
    starts = front = cut(steps.groupBy("key").agg(F.min("at").alias("at")))
    jump = steps.select("key", "at", "next")
    while True:  # starts found so far, and jumps that double in length
        front = starts.join(jump, ["key", "at"]).filter("next IS NOT NULL").select("key", F.col("next").alias("at"))
        found = cut(starts.unionByName(front).distinct())
        if found.count() == starts.count():
            break
        starts = found
        jump = cut(jump.join(jump.select("key", F.col("at").alias("next"), F.col("next").alias("further")), ["key", "next"], "left").select("key", "at", F.col("further").alias("next")))
    marked = limited.join(starts.withColumn("opens", F.lit(True)), ["key", "at"], "left")
    before = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row a slot
    earlier = limited.select("key", "slot").distinct().join(starts.groupBy("key", slot("at").alias("slot")).agg(F.max("at").alias("last")), ["key", "slot"], "left")
    earlier = earlier.withColumn("carried", F.max("last").over(before)).drop("last")
    own = F.max(F.when(F.col("opens"), F.col("at"))).over(Window.partitionBy("key", "slot").orderBy("at"))
    begun = marked.withColumn("own", own).join(earlier, ["key", "slot"], "left").withColumn("start", F.coalesce("own", "carried"))
    place = F.row_number().over(Window.partitionBy("key", "start").orderBy("at", "event"))
    done = begun.withColumn("allowed", place <= most)
    wait = F.greatest(F.lit(1), (F.col("start") + seconds - F.col("at")).cast("int") + 1)
    out = done.select("key", "event", "at", "allowed", F.when(F.col("allowed"), 0).otherwise(wait).alias("retry_after"))
    return out.unionByName(e.filter(F.coalesce(free, F.lit(False))).select("*", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after")))


def stream_rate_limit(events: DataFrame, most: int, seconds: float, exempt: tuple[str, ...] = ()) -> DataFrame:
    """The same on a stream: a key's state is its open window; within a micro-batch events count by time, later ones by the state of then."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["at", "event"], kind="stable")
        if key[0] in exempt or most <= 0 or seconds <= 0:
            yield pdf.assign(allowed=True, retry_after=0)
            return
        start, used = state.get if state.exists else (None, 0)
        allowed, retry, start, used = _consume(pdf["at"].tolist(), start, used, most, seconds)
        state.update((start, used))
        yield pdf.assign(allowed=allowed, retry_after=retry)

    e = events.select(F.col("key").cast("string"), F.col("event").cast("string"), F.col("at").cast("double"))
    return e.groupBy("key").applyInPandasWithState(run, _LIMIT_SCHEMA, "start double, used int", "append", GroupStateTimeout.NoTimeout)


def registry(requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``key_hash, name`` of ``requests (key, name, at)``, as if they were answered one by one in the order of ``at``, ties by key hash and name.

    A key without a binding is bound to the name that it asks for if no key has it; else the request is refused, and the key may ask
    again. ``known`` holds earlier bindings, which stay. Empty names and null keys ask for nothing. A request that is both the first
    of its key and the first for its name is granted, whatever else is asked; granted keys and names leave, and this is repeated until
    no request is left. The requests left over are those behind an earlier one for the name or by the key, so rounds are few.
    """
    r = requests.select(F.sha2(F.col("key").cast("string"), 256).alias("key_hash"), F.trim("name").alias("name"), "at").filter("key_hash IS NOT NULL AND name <> ''")
    order = F.struct("at", "key_hash", "name")
    left = r.groupBy("key_hash", "name").agg(F.min("at").alias("at"))
    if known is not None:
        left = left.join(known.select("key_hash"), "key_hash", "left_anti").join(known.select("name"), "name", "left_anti")
    left, granted = cut(left), None
    while not left.isEmpty():
        by_key = left.groupBy("key_hash").agg(F.min(order).alias("f")).select("f.*")
        by_name = left.groupBy("name").agg(F.min(order).alias("f")).select("f.*")
        now = cut(by_key.join(by_name, ["key_hash", "name", "at"]).select("key_hash", "name"))
        granted = now if granted is None else granted.unionByName(now)
        left = cut(left.join(now.select("key_hash"), "key_hash", "left_anti").join(now.select("name"), "name", "left_anti"))
    won = left.select("key_hash", "name") if granted is None else granted
    return won if known is None else known.select("key_hash", "name").unionByName(won)


def _latest(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """The table of the last version below ``before``, which names the version in ``_versions``."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    found = max((int(n[1:]) for n in names if n.startswith("v") and int(n[1:]) < before and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))), default=None)
    return None if found is None else spark.read.parquet(f"{folder}/v{found}")


def versioned(folder: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: version n of a table is version n-1 merged with batch n; a batch that is run again writes the same version again."""

    def run(batch: DataFrame, number: int) -> None:
        merge(batch, _latest(batch.sparkSession, folder, number)).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return run


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    return _latest(spark, folder, 2**62)


def best_submissions(results: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``team, notebook, metric, at``: the best of each (team, notebook), the earliest of equal ones; rows without a metric do not count."""
    rows = results.select("team", "notebook", "metric", "at").filter("metric IS NOT NULL")
    rows = rows if known is None else rows.unionByName(known)
    best = rows.groupBy("team", "notebook").agg(F.min(F.struct(-F.col("metric"), F.col("at"))).alias("b"))
    return best.select("team", "notebook", (-F.col("b.col1")).alias("metric"), F.col("b.at").alias("at"))


def history(results: DataFrame, team: str, n: int) -> DataFrame:
    """The newest n submissions of a team."""
    return results.filter(F.col("team") == team).orderBy(F.desc("at"), "notebook").limit(n)


def resume_scoring(work: DataFrame, done: DataFrame, key: str, score) -> DataFrame:
    """``key, score``: scores already made, and those of the other rows; a key that is done twice is an error."""
    if not done.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError("a key was scored twice")
    fresh = work.join(done.select(key), key, "left_anti").dropDuplicates([key])
    return done.select(key, "score").unionByName(fresh.select(key, score.alias("score")))


def stream_scores(stream: DataFrame, key: str, score) -> DataFrame:
    """Each key of a stream scored once; its checkpoint remembers the keys."""
    return stream.dropDuplicates([key]).select(key, score.alias("score"))
