"""Queries of scans, sinks, the ledger, stateful operators on tables and plugged-in functions, with their SQL.

What a scan reads is first written from the test tables to a folder below the shared one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import plugged
from ..sources import scans as S
from ..sources.tables import ledger, predictions, read
from ..streaming import state
from .common import P, rounded

_DOC = "doc_id long, lang string, n_chars long"
_RECORD = "team long, notebook string, metric double, at string, record long"


def _mod(column: str, n: int):
    return F.pmod(F.col(column), F.lit(n))


def _by_lang(df: DataFrame) -> DataFrame:
    return df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = S.scratch(spark, "jsonl")
    S.write_artifact(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return _by_lang(S.read_jsonl(spark, path, _DOC))


def jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh line is cut short, every fifth is older and lacks its length."""
    path = S.scratch(spark, "jsonl")
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.when(_mod("doc_id", 5) != 0, F.col("n_chars")).alias("n_chars"))
    line = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    docs.select(F.when(_mod("doc_id", 7) == 0, F.left(line, F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    return _by_lang(S.read_jsonl(spark, path, _DOC, "lenient", {"n_chars": 1000}))


def _submission(spark: SparkSession, sf_dir: str) -> str:
    """Predictions as a CSV with words for decisions; some rows break a rule."""
    path = S.scratch(spark, "submission")
    p = predictions(spark, sf_dir)
    words = F.when(_mod("index", 19) == 0, "maybe").when(F.col("decision") == 1, F.element_at(F.array(*[F.lit(x) for x in ("True", " yes", "1", "T")]), (_mod("index", 4) + 1).cast("int"))).otherwise("no ")
    score = F.when(_mod("index", 23) == 0, "high").when(_mod("index", 29) == 0, "1.5").otherwise(F.round("score", 6).cast("string"))
    rows = p.select("index", words.alias("deceptive"), score.alias("score"))
    S.write_artifact(rows.unionByName(rows.filter(_mod("index", 31) == 0)), path, "csv")
    return path


def submission_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load_predictions(spark, _submission(spark, sf_dir))[1]


def submission_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.load_predictions(spark, _submission(spark, sf_dir))[0])


def placed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose ids are their places."""
    return S.load_labels(spark, f"{sf_dir}/labels.parquet", "quality", "no_such_id")


def category_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two categories that name their columns differently."""
    root = S.scratch(spark, "categories")
    labels = read(spark, sf_dir, "labels")
    a = labels.filter(_mod("doc_id", 2) == 0).select(F.col("doc_id").alias("index"), F.col("quality").alias("deceptive"), "toxic")
    S.write_artifact(a, f"{root}/even", "parquet")
    S.write_artifact(labels.filter(_mod("doc_id", 2) == 1).select(F.col("doc_id").alias("Unnamed: 0"), F.col("quality").alias("dishonest"), "toxic"), f"{root}/odd", "parquet")
    return S.scan_category(spark, root, "even").unionByName(S.scan_category(spark, root, "odd"))


def keyed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a language, named ``docs__<lang>``, read by its name."""
    folder = S.scratch(spark, "stems")
    docs = read(spark, sf_dir, "documents").filter("lang IS NOT NULL")
    S.write_stems(docs.select(F.concat(F.lit("docs/"), "lang").alias("dataset"), "doc_id", "n_chars"), folder, "dataset")
    found = S.scan_keyed_csv(spark, folder, "*docs*.csv", ["doc_id", "n_chars"], ["doc_id"])
    return found.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_chars").cast("long")).alias("chars"))


def united_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    specs = [(p, "index % 3 = 0", 1.0), (p, "index % 3 = 1", 0.5)]
    return S.union_sources(specs, ["index"], ["unit", "label"]).select("unit", "index")


def partitioned_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice by unit; the second replaces the first."""
    path = S.scratch(spark, "artifact")
    p = predictions(spark, sf_dir).select("unit", "index", "decision")
    S.write_artifact(p, path, "json", ["unit"])
    S.write_artifact(p.filter(_mod("index", 2) == 0), path, "json", ["unit"])
    return spark.read.json(path).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("decision").alias("decisions"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("team", "notebook", F.round("metric", 6).alias("metric"), F.date_format("submitted_at", "yyyy-MM-dd").alias("at"), "record")


def result_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended in two parts, with lines that are no records between them."""
    path, r = S.scratch(spark, "ledger"), _records(spark, sf_dir)
    S.append_results(r.filter(_mod("record", 2) == 0), path)
    r.filter(_mod("record", 10) == 0).select(F.concat(F.lit("{broken "), "record").alias("value")).write.mode("append").text(path)
    S.append_results(r.filter(_mod("record", 2) == 1), path)
    return S.read_results(spark, path, _RECORD).groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.count("metric").alias("scored"), F.sum("record").alias("records"))


def wanted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scan_rows(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", ["lang", "n_chars"])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).select("key", F.col("event_id").alias("event"), (F.col("us") / 1e6).alias("at"))


def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = state.rate_limit(_events(spark, sf_dir), 3, 43_200, ("7",))
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("events"), F.count_if("allowed").alias("allowed"), F.sum("retry_after").alias("waits"))


def name_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    requests = o.select(F.concat(F.lit("k"), "o_custkey").alias("key"), F.when(_mod("o_orderkey", 4) != 0, F.concat(F.lit(" team "), _mod("o_orderkey", 97), F.lit(" "))).otherwise(" ").alias("name"), F.col("o_orderkey").alias("at"))
    return state.registry(requests)


def best_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.best_submissions(_records(spark, sf_dir))


def team_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).withColumn("at", F.concat_ws("#", "at", F.lpad(F.col("record").cast("string"), 9, "0")))
    return state.history(r.select("team", "notebook", "metric", "at", "record"), 7, 10)


def resumed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return state.resume_scoring(docs, docs.filter(_mod("doc_id", 3) == 0).select("doc_id", F.lit(-1).cast("long").alias("score")), "doc_id", F.col("n_chars"))


def _norm(part) -> list[float]:
    return [float(min(1.0, np.square(np.asarray(v, float)).sum())) for v in part["embedding"]]


def plugged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").filter("embedding IS NOT NULL AND NOT exists(embedding, v -> v IS NULL)")
    return plugged.score_with(e, _norm, 256).select("vec_id", F.round("score", 4).alias("score"))


def _is_long(text):
    return F.length(text) >= 1000


def ruled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    plugged.register_rule("long", _is_long)
    return read(spark, sf_dir, "documents").groupBy(plugged.rule("long", F.col("text")).alias("long")).agg(F.count(F.lit(1)).alias("n"))


_LEDGER = """r AS (SELECT o_custkey % 20 AS team, o_orderpriority AS notebook, CASE WHEN o_orderkey % 53 <> 0 THEN round(o_totalprice / 600000, 6) END AS metric, strftime(o_orderdate, '%Y-%m-%d') AS "at", o_orderkey AS record FROM orders)"""
_SUBMITTED = "s AS (SELECT index, CASE WHEN index % 19 = 0 THEN NULL ELSE decision END AS deceptive, CASE WHEN index % 23 = 0 THEN NULL WHEN index % 29 = 0 THEN 1.5 ELSE round(score, 6) END AS score, 1 + (index % 31 = 0)::INT AS n FROM p)"

QUERIES = {
    "jsonl_strict": (jsonl_strict, "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1"),
    "jsonl_lenient": (jsonl_lenient, "SELECT lang, count(*) AS n, sum(CASE WHEN doc_id % 5 <> 0 THEN coalesce(n_chars, 1000) ELSE 1000 END)::BIGINT AS chars FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1"),
    "submission_violations": (submission_violations, f"""
WITH {P}, {_SUBMITTED} SELECT 'repeated' AS rule, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS violations FROM s UNION ALL SELECT 'bad_deceptive', coalesce(sum(n) FILTER (deceptive IS NULL), 0)::BIGINT FROM s
UNION ALL SELECT 'bad_score', coalesce(sum(n) FILTER (score IS NULL), 0)::BIGINT FROM s UNION ALL SELECT 'out_of_range', coalesce(sum(n) FILTER (score > 1), 0)::BIGINT FROM s"""),
    "submission_rows": (submission_rows, f"WITH {P}, {_SUBMITTED} SELECT index, deceptive, score FROM s WHERE n = 1 AND deceptive IS NOT NULL AND score <= 1"),
    "placed_labels": (placed_labels, "SELECT row_number() OVER () - 1 AS index, quality AS label FROM labels"),
    "category_rows": (category_rows, "SELECT CASE WHEN doc_id % 2 = 0 THEN 'even:' ELSE 'odd:' END || doc_id AS sample_id, doc_id AS index, quality AS label, toxic FROM labels"),
    "keyed_csv": (keyed_csv, "SELECT 'docs/' || lang AS dataset, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IS NOT NULL GROUP BY 1"),
    "united_sources": (united_sources, f"""
WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY unit, label ORDER BY sha256('sources' || chr(31) || index), index) AS i, count(*) OVER (PARTITION BY unit, label) AS n FROM p WHERE index % 3 = 1)
SELECT unit, index FROM p WHERE index % 3 = 0 UNION ALL SELECT unit, index FROM r WHERE i <= greatest(1, floor(n * 0.5 + 0.5))"""),
    "partitioned_artifact": (partitioned_artifact, f"WITH {P} SELECT unit, count(*) AS n, sum(decision)::BIGINT AS decisions FROM p WHERE index % 2 = 0 GROUP BY 1"),
    "result_ledger": (result_ledger, f"WITH {_LEDGER} SELECT team, count(*) AS n, count(metric) AS scored, sum(record)::BIGINT AS records FROM r GROUP BY 1"),
    "wanted_rows": (wanted_rows, "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "rate_limited": (rate_limited, """
WITH RECURSIVE e AS (SELECT user_id % 20 AS key, event_id, epoch_us(ts) / 1e6 AS t FROM events),
w AS (SELECT key, min(t) AS start FROM e WHERE key <> 7 GROUP BY 1 UNION ALL SELECT w.key, (SELECT min(t) FROM e WHERE e.key = w.key AND e.t >= w.start + 43200) FROM w WHERE w.start IS NOT NULL),
b AS (SELECT e.*, (SELECT max(start) FROM w WHERE w.key = e.key AND w.start <= e.t) AS start FROM e WHERE key <> 7), c AS (SELECT *, row_number() OVER (PARTITION BY key, start ORDER BY t, event_id::VARCHAR) AS i FROM b)
SELECT key::VARCHAR AS key, count(*) AS events, count(*) FILTER (i <= 3) AS allowed, coalesce(sum(greatest(1, trunc(start + 43200 - t) + 1)) FILTER (i > 3), 0)::BIGINT AS waits FROM c GROUP BY 1
UNION ALL SELECT '7', count(*), count(*), 0 FROM e WHERE key = 7 HAVING count(*) > 0"""),
    "name_registry": (name_registry, """
WITH RECURSIVE q AS (SELECT sha256('k' || o_custkey) AS k, 'team ' || o_orderkey % 97 AS n, min(o_orderkey) AS t FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1, 2),
w AS (SELECT 0 AS i, [''] AS ks, [''] AS ns, NULL::VARCHAR AS key_hash, NULL::VARCHAR AS name UNION ALL
SELECT i + 1, list_append(ks, f.k), list_append(ns, f.n), f.k, f.n FROM (SELECT i, ks, ns, (SELECT arg_min({'k': k, 'n': n}, (t, k, n)) FROM q WHERE NOT list_contains(w.ks, k) AND NOT list_contains(w.ns, n)) AS f FROM w) WHERE f IS NOT NULL)
SELECT key_hash, name FROM w WHERE i > 0"""),
    "best_submissions": (best_submissions, f"""WITH {_LEDGER} SELECT team, notebook, max(metric) AS metric, arg_min("at", (-metric, "at")) AS "at" FROM r WHERE metric IS NOT NULL GROUP BY 1, 2"""),
    "team_history": (team_history, f"""WITH {_LEDGER}, h AS (SELECT * REPLACE ("at" || '#' || lpad(record::VARCHAR, 9, '0') AS "at") FROM r) SELECT team, notebook, metric, "at", record FROM h WHERE team = 7 ORDER BY "at" DESC, notebook LIMIT 10"""),
    "resumed_scores": (resumed_scores, "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE n_chars END AS score FROM documents"),
    "plugged_scores": (plugged_scores, "SELECT vec_id, round(least(1.0, list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 4) AS score FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL)) = 0"),
    "ruled_rows": (ruled_rows, "SELECT length(text) >= 1000 AS long, count(*) AS n FROM documents GROUP BY 1"),
}
