"""Queries of row selection, audits, reuse, facts and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, conversations, intervals, retrieval, sampling, selection
from ..sources.tables import predictions, read, second_predictions
from .common import B, P, rounded

_RULES = [("code", "(?i)(code|function)"), ("question", r"[?]"), ("long", "(?s)^.{400}")]
_LEAK = "(?i)(password|api_key)"


def _preds(make):
    return lambda spark, sf: rounded(make(predictions(spark, sf)))


def _digest(seed: str, key: str = "index") -> str:
    return f"sha256('{seed}' || chr(31) || {key})"


def rank_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return rounded(selection.rank_average([p, second_predictions(p)]))


def budgeted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = selection.char_budget(F.split("text", "\n"), 500)
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.size(kept).alias("kept"), F.length(F.array_join(kept, "")).alias("chars"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return selection.sentence_windows(lines, "doc_id", "place", "line").select("doc_id", "place", "size", F.md5("window").alias("digest"))


def manifest_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a manifest of an earlier state, in which some rows lacked or differed."""
    now = read(spark, sf_dir, "labels")
    before = now.filter("doc_id % 11 <> 0").withColumn("toxic", F.when(F.expr("doc_id % 7 = 0"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return audits.verify_manifest(now.filter("doc_id % 13 <> 0"), audits.write_manifest(before, "doc_id", ["quality", "toxic"]), "doc_id", ["quality", "toxic"])


def soft_targets(preds: DataFrame) -> DataFrame:
    return audits.soft_targets(preds.withColumn("z", F.pmod("index", F.lit(97)).cast("double")), "unit", "z").select("index", "target")


def reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    old = docs.filter("doc_id % 3 <> 0").withColumn("lang", F.when(F.expr("doc_id % 5 = 0"), "xx").otherwise(F.col("lang")))
    cache = audits.write_manifest(old, "doc_id", ["text", "lang"]).withColumn("size", F.lit(-1))
    return audits.reuse_or_compute(docs, cache, "doc_id", ["text", "lang"], "size", F.length("text")).select("doc_id", "reused", "size")


def active_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers between their first and last order in each year of shipping."""
    facts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("start"), F.year(F.max("o_orderdate")).alias("end"))
    claims = read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    return intervals.facts_at(facts, claims, "start", "end", "year").groupBy("year").agg(F.count(F.lit(1)).alias("customers"))


def merged_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parts of each supplier by quantity and by discount, as one list."""
    li = read(spark, sf_dir, "lineitem")
    by = lambda value: li.groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum(value), 4).alias("v"))
    one, two = (_best_parts(by(v)) for v in ("l_quantity", "l_discount"))
    return audits.merge_channels([one, two], "l_suppkey", "l_partkey")


def _best_parts(df: DataFrame, k: int = 5) -> DataFrame:
    return retrieval.top_k(df, ["l_suppkey"], [F.desc("v"), F.asc("l_partkey")], k)


def _turns(make):
    return lambda spark, sf: make(read(spark, sf, "conversations"))


_DIALOGUE = "string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, upper(role) || ': ' || coalesce(text, ''))"
_RANKS = "rank() OVER (PARTITION BY unit ORDER BY score) + (count(*) OVER (PARTITION BY unit, score) - 1) / 2.0"

QUERIES = {
    "scored_fraction": (_preds(lambda p: selection.scored_fraction(p, 0.25, ["unit"]).select("index", "unit", "top", "control")), f"""
WITH {P},
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, index) AS a, row_number() OVER (PARTITION BY unit ORDER BY {_digest('control')}, index) AS b, round_even(0.25 * count(*) OVER (PARTITION BY unit), 0) AS n FROM p)
SELECT index, unit, (a <= n)::INT AS top, (b <= n)::INT AS control FROM r WHERE a <= n OR b <= n
"""),
    "anchored_sample": (_preds(lambda p: selection.anchored_sample(p, 0.2, 0.1, ["unit"]).select("index", "unit", "kind")), f"""
WITH {P},
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY abs(score - 0.1::DOUBLE), index) AS r, count(*) OVER (PARTITION BY unit) AS t FROM p),
k AS (SELECT *, least(floor(t * 0.2::DOUBLE + 0.5), t // 2) AS n FROM r)
SELECT index, unit, CASE WHEN r <= n THEN 'near' ELSE 'far' END AS kind FROM k WHERE r <= n OR r > t - n
"""),
    "hard_with_controls": (_preds(lambda p: selection.hard_with_controls(p, F.col("decision") == 0, 0.5).select("index", "label")), f"""
WITH {P},
h AS (SELECT index, label FROM p WHERE label = 1 AND decision = 0),
n AS (SELECT index, label, row_number() OVER (ORDER BY {_digest('hard')}, index) AS r FROM p WHERE label = 0)
SELECT * FROM h
UNION ALL SELECT index, label FROM n WHERE r <= (SELECT round_even(count(*) * 0.5, 0) FROM h)
"""),
    "rank_average": (rank_average, f"""
WITH {P}, {B},
a AS (SELECT index, unit, ({_RANKS}) / count(*) OVER (PARTITION BY unit) AS f FROM p
UNION ALL SELECT index, unit, ({_RANKS}) / count(*) OVER (PARTITION BY unit) FROM b)
SELECT index, unit, round(avg(f), 6) AS fused FROM a GROUP BY 1, 2
"""),
    "quota_sample": (_preds(lambda p: selection.quota_sample(p, 60, ["label", "scenario"]).select("index", "label", "scenario")), f"""
WITH {P},
r AS (SELECT *, row_number() OVER (PARTITION BY label, scenario ORDER BY {_digest('quota')}, index) AS i FROM p),
t AS (SELECT *, row_number() OVER (ORDER BY i, label, scenario) AS k FROM r)
SELECT index, label, scenario FROM t WHERE k <= 60
"""),
    "budgeted_lines": (budgeted_lines, """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS used, 0 AS kept FROM documents WHERE text IS NOT NULL
UNION ALL SELECT w.doc_id, l.i, CASE WHEN used + length(line) <= 500 THEN used + length(line) ELSE used END, CASE WHEN used + length(line) <= 500 THEN kept + 1 ELSE kept END FROM w JOIN l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
SELECT doc_id, arg_max(kept, i)::INT AS kept, arg_max(used, i)::INT AS chars FROM w GROUP BY 1
"""),
    "sentence_windows": (windows, """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS place FROM documents),
n AS (SELECT *, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY place))
SELECT doc_id, place, 1 AS size, md5(line) AS digest FROM n
UNION ALL SELECT doc_id, place, 2, md5(line || ' ' || b) FROM n WHERE b IS NOT NULL
UNION ALL SELECT doc_id, place, 3, md5(line || ' ' || b || ' ' || c) FROM n WHERE c IS NOT NULL
"""),
    "dedupe_first": (lambda s, d: sampling.dedupe_first(read(s, d, "documents"), ["text"], ["doc_id"]).select("doc_id", "lang"), "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text"),
    "cache_audit": (lambda s, d: audits.audit_cache(read(s, d, "documents").join(read(s, d, "labels"), "doc_id"), "doc_id", "quality", "text", _LEAK), f"""
WITH j AS (SELECT * FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS k, count(*) FILTER (coalesce(quality, -1) NOT IN (0, 1)) AS bad, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty, count(*) FILTER (regexp_matches(text, '{_LEAK}')) AS leaks, abs(count(*) FILTER (quality = 1) - count(*) FILTER (quality = 0)) AS imbalance FROM j)
SELECT n AS rows, n - k AS repeated, bad AS bad_labels, empty, leaks, imbalance, n - k + bad + empty + leaks = 0 AS passed FROM c
"""),
    "manifest_drift": (manifest_drift, """
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'new' ELSE 'changed' END AS kind FROM labels WHERE (doc_id % 13 = 0) <> (doc_id % 11 = 0) OR (doc_id % 13 <> 0 AND doc_id % 11 <> 0 AND doc_id % 7 = 0)
"""),
    "soft_targets": (_preds(soft_targets), f"""
WITH {P},
g AS (SELECT unit, avg((index % 97)::DOUBLE) AS m, stddev_pop((index % 97)::DOUBLE) AS s FROM p GROUP BY unit)
SELECT index, round(1 / (1 + exp(-CASE WHEN s > 0 THEN ((index % 97) - m) / s ELSE 0 END)), 6) AS target FROM p JOIN g USING (unit)
"""),
    "hash_dropout": (lambda s, d: audits.hash_dropout(read(s, d, "labels"), "toxic", 0.3, "doc_id"), """
SELECT doc_id, quality, CASE WHEN ('0x' || sha256('drop' || chr(31) || doc_id)[1:13])::BIGINT::DOUBLE / 4503599627370496.0 >= 0.3 THEN toxic END AS toxic FROM labels
"""),
    "reuse_or_compute": (reuse, """
SELECT doc_id, (doc_id % 3 <> 0 AND (doc_id % 5 <> 0 OR lang = 'xx') AND text IS NOT NULL)::INT AS reused, CASE WHEN doc_id % 3 <> 0 AND (doc_id % 5 <> 0 OR lang = 'xx') AND text IS NOT NULL THEN -1 ELSE length(text) END::INT AS size FROM documents
"""),
    "active_customers": (active_customers, """
WITH f AS (SELECT o_custkey, year(min(o_orderdate)) AS a, year(max(o_orderdate)) AS z FROM orders GROUP BY 1),
c AS (SELECT DISTINCT year(l_shipdate)::INT AS year FROM lineitem)
SELECT year, count(*) AS customers FROM c JOIN f ON year BETWEEN a AND z GROUP BY year
"""),
    "merged_channels": (merged_channels, """
WITH g AS (SELECT l_suppkey, l_partkey, round(sum(l_quantity), 4) AS q, round(sum(l_discount), 4) AS d FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey)::INT AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY d DESC, l_partkey)::INT AS b FROM g)
SELECT l_suppkey, l_partkey, least(a, b) AS rank, (a <= 5)::BIGINT + (b <= 5)::BIGINT AS channels FROM r WHERE a <= 5 OR b <= 5
"""),
    "keys_except": (lambda s, d: audits.keys_except(read(s, d, "customer").withColumnRenamed("c_custkey", "key"), read(s, d, "orders").withColumnRenamed("o_custkey", "key"), "key"), "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "popularity": (lambda s, d: rounded(audits.popularity(read(s, d, "events").withColumn("name", F.concat(F.col("event_type"), F.lit(":"), F.expr("user_id % 50"))), "name", "value", "^error:").withColumn("total", F.round("total", 3))), "SELECT event_type || ':' || (user_id % 50) AS name, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE event_type <> 'error' GROUP BY 1"),
    "render_dialogue": (_turns(lambda t: conversations.render_dialogue(t).select("conv_id", F.md5("dialogue").alias("digest"))), f"SELECT conv_id, md5({_DIALOGUE}) AS digest FROM conversations GROUP BY 1"),
    "filter_structure": (_turns(lambda t: conversations.filter_structure(t, "assistant", 100, 2)), """
WITH l AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(text, '') DESC) AS rn FROM conversations WHERE role = 'assistant')
SELECT conv_id, length(text)::INT AS chars, len(regexp_extract_all(text, '[.!?]+'))::INT AS ends FROM l WHERE rn = 1 AND length(text) >= 100 AND len(regexp_extract_all(text, '[.!?]+')) >= 2
"""),
    "expand_conditions": (_turns(lambda t: conversations.expand_conditions(t, "system").select("conv_id", "condition", F.md5("dialogue").alias("digest"))), f"""
SELECT conv_id, 'original' AS condition, md5({_DIALOGUE}) AS digest FROM conversations GROUP BY 1
UNION ALL SELECT conv_id, 'removed', md5({_DIALOGUE}) FROM conversations WHERE role <> 'system' GROUP BY 1
"""),
    "route_coverage": (_turns(lambda t: conversations.route(t, _RULES, "text").groupBy("role", "route").agg(F.count(F.lit(1)).alias("n"))), """
SELECT role, CASE WHEN regexp_matches(text, '(?i)(code|function)') THEN 'code' WHEN regexp_matches(text, '[?]') THEN 'question' WHEN length(text) >= 400 THEN 'long' ELSE 'none' END AS route, count(*) AS n FROM conversations GROUP BY 1, 2
"""),
}
