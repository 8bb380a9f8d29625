"""Queries of text functions, votes, thresholds, comparisons and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decisions, metrics, retrieval, votes
from ..sources.tables import ledger, members, predictions, read, second_predictions
from .common import B, P, rounded, with_confusion

_M = "mm AS (SELECT index, label, 0 AS member, decision FROM p UNION ALL SELECT index, label, 1, decision FROM b UNION ALL SELECT index, label, 2, (index % 3 = 0)::INT FROM p)"
_T = "u AS (SELECT unit, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM p GROUP BY unit HAVING count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0), g AS (SELECT unnest(range(0, 101))::INT AS bin), t AS (SELECT u.unit, bin, pos, neg, (SELECT count(*) FROM p WHERE p.unit = u.unit AND label = 1 AND floor(score * 100)::INT >= bin) AS tp, (SELECT count(*) FROM p WHERE p.unit = u.unit AND label = 0 AND floor(score * 100)::INT >= bin) AS fp FROM u, g), ba AS (SELECT unit, bin, (tp / pos::DOUBLE + 1 - fp / neg::DOUBLE) / 2 AS ba, fp / neg::DOUBLE AS fpr FROM t)"


def _docs(make):
    return lambda spark, sf: read(spark, sf, "documents").select("doc_id", *make(F.col("text")))


def _preds(make):
    return lambda spark, sf: rounded(make(predictions(spark, sf)))


def _members(make):
    return lambda spark, sf: rounded(make(members(predictions(spark, sf))))


def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.content_terms(F.col("text"))).alias("place", "term"))


def verdicts(preds: DataFrame) -> DataFrame:
    s = F.col("score")
    z = F.pmod("index", F.lit(97)) / 97.0
    return preds.select("index", T.verdict(s * z, 1 - s, s * (1 - z), 0.05).alias("verdict"))


def expected_ratings(preds: DataFrame) -> DataFrame:
    c = preds.groupBy("scenario", F.pmod("index", F.lit(7)).alias("rating")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return c.groupBy("scenario").agg(F.map_from_entries(F.collect_list(F.struct("rating", "n"))).alias("shares")).select("scenario", T.expected_rating(F.col("shares"), 0, 6).alias("expected"))


def mined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return rounded(decisions.mine_rules(rows.select("label", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("terms")), "terms", 20))


def applied_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by the best rule that the labelled ones gave."""
    return decisions.apply_rules(read(spark, sf_dir, "documents"), mined_rules(spark, sf_dir), "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    ranked = retrieval.bm25(docs, items, "doc_id", "text", "item_id", "text", 10).select("item_id", "doc_id", "rank")
    texts = ranked.join(docs.select("doc_id", "text"), "doc_id").join(items.select("item_id", F.col("text").alias("wanted")), "item_id")
    return decisions.recovery_at_k(texts.withColumn("hit", F.expr("contains(text, wanted)")), "item_id", [1, 3, 5, 10])


def flag_audit(preds: DataFrame) -> DataFrame:
    return decisions.flag_audit(preds, "decision", ["scenario"])


def _two(make):
    def run(spark, sf):
        p = predictions(spark, sf)
        return rounded(make(p, second_predictions(p)))

    return run


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return rounded(decisions.length_strata(p, "score"))


def _bm25_sql() -> str:
    from .queries import _QUERIES

    return _QUERIES["search_bm25"][1]


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))::INT"


_RULES_SQL = """
WITH t AS (SELECT DISTINCT d.doc_id, l.quality AS label, unnest(regexp_extract_all(lower(d.text), '[a-z]{4,}')) AS term FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT term, count(*) AS support, count(*) FILTER (label = 1) AS positives FROM t GROUP BY 1 HAVING count(*) >= 20 AND count(*) FILTER (label = 1) > 0),
q AS (SELECT *, positives / support::DOUBLE AS r FROM g)
SELECT term, support, positives, round((r + 1 / (2.0::DOUBLE * support) - sqrt(r * (1 - r) / support + 1 / (4.0::DOUBLE * support * support)))
/ (1 + 1 / support::DOUBLE), 6) AS lower FROM q
"""
_APPLIED = f"""
WITH rules AS ({_RULES_SQL}), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS term FROM documents), s AS (SELECT doc_id, max(lower) AS score FROM d JOIN rules USING (term) GROUP BY 1)
SELECT doc_id, coalesce(score, 0.0) AS score FROM documents LEFT JOIN s USING (doc_id)
"""

QUERIES = {
    "truncated_text": (_docs(lambda t: [F.md5(T.truncate_text(t, 200, m)).alias(m) for m in ("head", "tail", "head_tail")]), """
SELECT doc_id, md5(CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || ' ... ' END) AS head, md5(CASE WHEN length(text) <= 200 THEN text ELSE ' ... ' || right(text, 200) END) AS tail, md5(CASE WHEN length(text) <= 200 THEN text ELSE left(text, 100) || ' ... ' || right(text, 100) END) AS head_tail FROM documents
"""),
    "normalized_names": (_docs(lambda t: [F.md5(T.normalize_name(t)).alias("digest")]), r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g'), ' '), '(^| )st ', '\1saint ', 'g'), '^the ', '')) AS digest FROM documents
"""),
    "content_terms": (content_terms, """
WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
x AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM t),
y AS (SELECT item_id, term, min(i) AS i FROM x WHERE length(term) >= 4 GROUP BY 1, 2),
z AS (SELECT item_id, term, (row_number() OVER (PARTITION BY item_id ORDER BY i) - 1)::INT AS place FROM y)
SELECT item_id, place, term FROM z WHERE place < 12
"""),
    "split_sentences": (_docs(lambda t: [F.size(T.split_sentences(t)).alias("n"), F.md5(F.array_join(T.split_sentences(t), "|")).alias("digest")]), r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda s: trim(s, ' ')), lambda s: length(s) >= 20) AS s FROM documents)
SELECT doc_id, len(s)::INT AS n, md5(coalesce(array_to_string(s, '|'), '')) AS digest FROM s
"""),
    "extracted_tags": (lambda s, d: read(s, d, "pages").select("page_id", F.md5(T.extract_tag(F.col("html"), "p")).alias("digest")), "SELECT page_id, md5(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1)[-1]) AS digest FROM pages"),
    "text_shapes": (lambda s, d: rounded(read(s, d, "documents").select("doc_id", *T.text_shape(F.col("text")))), f"""
SELECT doc_id, round(ln(1 + length(text)), 6) AS log_chars, {_count('[A-Za-z0-9]+')} AS tokens, {_count('[.!?]+')} AS stops, {_count('[0-9]+')} AS numbers, {_count(chr(34))} AS quotes, {_count('[$€£]')} AS currencies FROM documents
"""),
    "log_odds_blend": (_two(lambda a, b: a.join(b.select("index", F.col("score").alias("other")), "index").select("index", T.log_odds_blend([F.col("score"), F.col("other")], [0.7, 0.3]).alias("blend"))), f"""
WITH {P}, {B},
c AS (SELECT index, least(greatest(p.score, 1e-8), 1 - 1e-8) AS x, least(greatest(b.score, 1e-8), 1 - 1e-8) AS y FROM p JOIN b USING (index))
SELECT index, round(1 / (1 + exp(-(0.7::DOUBLE * ln(x / (1 - x)) + 0.3::DOUBLE * ln(y / (1 - y))))), 6) AS blend FROM c
"""),
    "expected_ratings": (_preds(expected_ratings), f"WITH {P} SELECT scenario, round(avg((index % 7) / 6.0::DOUBLE), 6) AS expected FROM p GROUP BY 1"),
    "verdicts": (_preds(verdicts), f"""
WITH {P},
v AS (SELECT index, score * ((index % 97) / 97.0::DOUBLE) AS e, 1 - score AS n, score * (1 - (index % 97) / 97.0::DOUBLE) AS c FROM p)
SELECT index, CASE WHEN greatest(e, c) < 0.05 OR n > greatest(e, c) THEN 'NOT_ENOUGH_INFO' WHEN e >= c THEN 'SUPPORTS' ELSE 'REFUTES' END AS verdict FROM v
"""),
    "votes": (_members(lambda m: votes.vote(m, 3)), f"""
WITH {P}, {B}, {_M} SELECT index, any_value(label) AS label, max(decision) AS any, (sum(decision) >= 2)::INT AS majority, min(decision) AS unanimous, round(avg(decision), 6) AS mean FROM mm GROUP BY index
"""),
    "disagreement": (_members(votes.disagreement), f"""
WITH {P}, {B}, {_M} SELECT x.member AS first, y.member AS second, count(*) AS n, count(*) FILTER (x.decision <> y.decision) AS differ FROM mm x JOIN mm y ON x.index = y.index AND x.member < y.member GROUP BY 1, 2
"""),
    "cascade_cost": (_members(votes.cascade_cost), f"""
WITH {P}, {B}, {_M},
s AS (SELECT *, coalesce(min(member) FILTER (decision = 1) OVER (PARTITION BY index), max(member) OVER (PARTITION BY index)) AS stop FROM mm)
SELECT member, count(*) AS asked, count(*) FILTER (member = stop) AS stopped FROM s WHERE member <= stop GROUP BY member
"""),
    "escalation": (_members(lambda m: votes.escalate(m, [0, 1], 2)), f"""
WITH {P}, {B}, {_M},
w AS (SELECT index, max(decision) FILTER (member = 0) AS x, max(decision) FILTER (member = 1) AS y, max(decision) FILTER (member = 2) AS z FROM mm GROUP BY index)
SELECT index, (x <> y)::INT AS queried, CASE WHEN x <> y THEN z ELSE x END AS decision FROM w
"""),
    "pivot_members": (_members(lambda m: votes.pivot_members(m, [0, 1, 2])), f"""
WITH {P}, {B}, {_M} SELECT index, max(decision) FILTER (member = 0) AS m0, max(decision) FILTER (member = 1) AS m1, max(decision) FILTER (member = 2) AS m2 FROM mm GROUP BY index
"""),
    "select_threshold": (_preds(lambda p: decisions.select_threshold(metrics.threshold_sweep(p))), f"""
WITH {P}, {_T},
s AS (SELECT bin, avg(ba) AS macro_ba, avg(fpr) AS macro_fpr FROM ba GROUP BY bin)
SELECT bin, round(macro_ba, 6) AS macro_ba, round(macro_fpr, 6) AS macro_fpr FROM s ORDER BY round(macro_ba, 9) DESC, round(macro_fpr, 9), (bin = 50)::INT DESC, bin LIMIT 1
"""),
    "loo_threshold": (_preds(decisions.loo_threshold), f"""
WITH {P}, {_T},
r AS (SELECT x.unit, x.bin, x.ba, round((SELECT sum(y.ba) FROM ba y WHERE y.bin = x.bin) - x.ba, 9) AS rest FROM ba x),
k AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY rest DESC, bin DESC) AS rn FROM r)
SELECT unit, bin, round(ba, 6) AS ba FROM k WHERE rn = 1
"""),
    "operating_point": (_preds(lambda p: decisions.operating_point(p, 5, 0.6)), f"""
WITH {P},
s AS (SELECT DISTINCT unit, score AS threshold FROM p),
c AS (SELECT s.unit, threshold, count(*) FILTER (label = 1) AS correct, count(*) AS emitted FROM s JOIN p ON p.unit = s.unit AND p.score >= threshold GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY correct DESC, emitted DESC) AS rn FROM c WHERE emitted >= 5 AND correct >= 0.6 * emitted)
SELECT u.unit, round(coalesce(threshold, top + 1e-6), 6) AS threshold, coalesce(correct, 0) AS correct, coalesce(emitted, 0) AS emitted FROM (SELECT unit, max(score) AS top FROM p GROUP BY 1) u LEFT JOIN r ON r.unit = u.unit AND rn = 1
"""),
    "score_diagnostics": (_preds(decisions.score_diagnostics), f"""
WITH {P} SELECT unit, count(*) AS n, count(DISTINCT score) AS \"distinct\", round(1 - count(DISTINCT score) / count(*)::DOUBLE, 6) AS duplicates, count(*) FILTER (score < 1e-6) AS low, count(*) FILTER (score > 1 - 1e-6) AS high, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50, round(quantile_cont(score, 0.75), 6) AS q75 FROM p GROUP BY unit
"""),
    "unit_wins": (_two(decisions.unit_wins), f"""
WITH {P}, {B},
x AS ({with_confusion('p', 'unit')}),
y AS ({with_confusion('b', 'unit')}),
d AS (SELECT y.ba - x.ba AS d FROM x JOIN y USING (unit) WHERE y.ba - x.ba IS NOT NULL)
SELECT count(*) FILTER (d > 1e-12) AS wins, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses, round(max(d), 6) AS best, round(min(d), 6) AS worst FROM d
"""),
    "length_strata": (_lengths, f"""
WITH {P},
s AS (SELECT *, ntile(3) OVER (PARTITION BY unit ORDER BY score, index)::INT AS part FROM p)
SELECT unit, part, count(*) AS n, round(avg((label = decision)::INT), 6) AS accuracy FROM s GROUP BY 1, 2
"""),
    "flag_audit": (_preds(flag_audit), f"""
WITH {P},
c AS (SELECT scenario, count(*) FILTER (decision = 1) AS flags, count(*) FILTER (decision = 1 AND label = 1) AS hits, count(*) FILTER (decision = 1 AND label <> 1) AS false_flags, count(*) FILTER (label = 1) AS pos FROM p GROUP BY 1)
SELECT scenario, flags, hits, false_flags, CASE WHEN flags > 0 THEN round(hits / flags::DOUBLE, 6) END AS precision, CASE WHEN pos > 0 THEN round(hits / pos::DOUBLE, 6) END AS coverage FROM c
"""),
    "crosstab": (_preds(lambda p: decisions.crosstab(p, "scenario", "label")), f"""
WITH {P},
c AS (SELECT scenario, label, count(*) AS n FROM p GROUP BY 1, 2)
SELECT *, round(n / sum(n) OVER (PARTITION BY scenario)::DOUBLE, 6) AS share FROM c
"""),
    "mined_rules": (mined_rules, _RULES_SQL),
    "applied_rules": (applied_rules, _APPLIED),
    "submission_summary": (lambda s, d: rounded(decisions.summarize_submissions(ledger(s, d))), """
WITH r AS (SELECT o_custkey % 20 AS team, o_orderpriority AS notebook, o_orderdate AS submitted_at, o_orderkey % 7 AS unit, CASE WHEN o_orderkey % 53 <> 0 THEN o_totalprice / 600000 END AS metric, o_orderkey % 53 <> 0 AS ok FROM orders)
SELECT team, notebook, submitted_at, bool_and(ok) AS ok, CASE WHEN bool_and(ok) THEN round(sum(metric::DECIMAL(28, 12))::DOUBLE / count(metric), 6) END AS mean, min(unit) FILTER (NOT ok) AS failed_unit, count(*) AS units FROM r GROUP BY 1, 2, 3
"""),
    "recovery_at_k": (recovery, lambda: f"""
WITH k AS ({_bm25_sql()}),
f AS (SELECT k.item_id, min(rank) FILTER (contains(d.text, b.text)) AS r FROM k JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) GROUP BY 1)
SELECT count(*) AS asked, count(*) FILTER (r <= 1) AS at_1, count(*) FILTER (r <= 3) AS at_3, count(*) FILTER (r <= 5) AS at_5, count(*) FILTER (r <= 10) AS at_10 FROM f
"""),
}
