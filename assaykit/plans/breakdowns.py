"""Queries of breakdowns, text repairs and finer audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import breakdowns as D
from ..operators import retrieval, sampling, selection
from ..operators.metrics import cell_metrics
from ..sources.tables import predictions, read, second_predictions
from .common import B, P, rounded, with_confusion
from .comparisons import J, both


def _mod(column: str, n: int):
    return F.pmod(F.col(column), F.lit(n))


def _preds(make):
    return lambda spark, sf: rounded(make(predictions(spark, sf)))


def _both(make):
    return lambda spark, sf: rounded(make(both(spark, sf)))


def _docs(make):
    return lambda spark, sf: make(read(spark, sf, "documents"))


def vote_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    parts = [p.select("index", F.lit(i).alias("member"), s.alias("score")) for i, s in enumerate((F.col("score"), _mod("index", 97) / 97.0, _mod("index", 5) / 5.0))]
    short = parts[2].filter(_mod("index", 4) != 0)
    return rounded(D.vote_scores(parts[0].unionByName(parts[1]).unionByName(short), 3))


def member_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three members whose probabilities add up to 1, but for some rows."""
    p = predictions(spark, sf_dir).select("index", "label")
    share = F.element_at(F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)), (F.pmod(F.col("index") + F.col("member"), F.lit(3)) + 1).cast("int"))
    m = p.withColumn("member", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).filter("index % 11 <> 0 OR member > 0")
    m = m.withColumn("p", F.when((_mod("index", 7) == 0) & (F.col("member") == 2), 0.1).otherwise(share)).withColumn("label", F.when((_mod("index", 13) == 0) & (F.col("member") == 1), 1 - F.col("label")).otherwise(F.col("label")))
    return D.member_targets(m, "index", 3, "p", "label")


def usage_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("usage", F.from_json("props", "map<string,double>"))
    return D.map_totals(e, ["event_type"], F.map_concat("usage", F.create_map(F.lit("calls"), F.lit(1.0))))


def unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("unit", F.col("scenario"))
    return rounded(D.worst_units(p.withColumn("decision", F.when(_mod("index", 9) != 0, F.col("decision"))), "unit", 3))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return rounded(D.reciprocal_fusion([p, second_predictions(p)], "unit", "index"))


def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the two windows of lines of each size with most commas."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    w = selection.sentence_windows(lines, "doc_id", "place", "line", 2)
    return D.scored_windows(w, "doc_id", "place", "size", F.regexp_count("window", F.lit(",")) / 10.0, 2).select("doc_id", "size", "place", "relevance", "rank")


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return D.coverage_reasons(docs.select("doc_id", "lang"), labels.filter(_mod("doc_id", 3) != 0).select(F.when(_mod("doc_id", 5) == 0, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.lit("label").alias("lang")), "doc_id", "lang")


def cache_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    rules = {"no_text": F.col("text").isNull(), "empty": F.length("text") == 0, "length": F.col("n_chars") != F.length("text"), "language": ~F.col("lang").isin("en", "de", "fr", "es"), "toxic_good": (F.col("toxic") == 1) & (F.col("quality") == 1)}
    return D.rule_audit(j, rules)


def seen_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sampling.group_split(predictions(spark, sf_dir).withColumn("group", F.concat_ws("|", "scenario", "unit")), "group", 0.3)
    return sampling.mark_seen(p.filter("side = 'test'"), p.filter("side = 'train'"), "scenario").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("index").alias("rows"))


def full_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.full_sample(predictions(spark, sf_dir), 10, "label", "scenario").select("index", "label")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("long", F.col("n_chars") > 3000), ("english", F.col("lang") == "en"), ("digits", F.col("text").rlike("[0-9]{4}"))]
    return D.exclusive_routes(read(spark, sf_dir, "documents"), rules, "doc_id")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.views_of_dialogue(read(spark, sf_dir, "conversations"))
    cut = {"user": "quarter", "assistant": "three_quarters", "first_user": "third", "last_user": "head_tail"}
    return v.select("conv_id", *[F.md5(X.truncate_text(F.col(c), 120, mode)).alias(c) for c, mode in cut.items()])


def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.sanitised_condition(read(spark, sf_dir, "conversations"), "(?i)th[a-z]*")
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def repairs(df: DataFrame) -> DataFrame:
    """Whole texts between references, and their bytes around a byte that begins no character."""
    t = F.concat(F.lit("&lt;p&gt; &amp;amp; "), F.col("text"), F.lit(" &ndash; "), F.char(F.lit(7)))
    body = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("FF")), F.encode("lang", "utf-8"))
    return df.filter("text IS NOT NULL").select("doc_id", F.md5(X.unescape(t)).alias("plain"), F.md5(X.repaired(body)).alias("valid"))


def fields(df: DataFrame) -> DataFrame:
    t = F.concat(F.lit("Rating: 1\nPrediction: no\nRating:  "), _mod("doc_id", 10), F.lit(" \nend"))
    return df.select("doc_id", X.last_field(t, "rating").alias("rating"), X.last_field(t, "prediction").alias("prediction"), X.last_field(t, "verdict").alias("verdict"))


def heading_free(df: DataFrame) -> DataFrame:
    t = F.concat(F.lit("== History of all things ==\n# A heading of some length\n"), F.regexp_replace("text", "[=#]", ""))
    return df.filter("text IS NOT NULL").select("doc_id", F.size(X.prose_sentences(t)).alias("n"))


def folded_first(df: DataFrame) -> DataFrame:
    """The first document of each text, whatever its case and spaces."""
    return sampling.dedupe_first(df.select("doc_id", "lang", F.trim(F.regexp_replace(F.lower("text"), "[ \\t\\n\\r\\f\\x0B]+", " ")).alias("folded")), ["folded"], ["doc_id"]).select("doc_id", "lang")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without an error or an empty body, their tags as spaces; of a site's equal sentences the first page's."""
    p = read(spark, sf_dir, "pages").filter("html IS NOT NULL AND length(html) > 0")
    text = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    site = F.regexp_extract("url", "^https?://([^/]+)", 1)
    s = retrieval.page_sentences(p.select("page_id", X.unescape(text).alias("t")), "page_id", "t").join(p.select("page_id", site.alias("site")), "page_id")
    return s.groupBy("site", F.md5(F.lower("sentence")).alias("digest")).agg(F.min("page_id").alias("page_id"))


def found_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.bm25(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 10)
    marked = hits.join(retrieval.text_containment(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text").select("item_id", "doc_id", F.lit(True).alias("hit")), ["item_id", "doc_id"], "left")
    return D.recovered_rows(marked.withColumn("hit", F.coalesce("hit", F.lit(False))), "item_id", F.floor(F.col("item_id") / 4), [1, 5, 10])


_NAMES = ["recall", "fpr", "balanced_accuracy", "auroc"]


def _scored(keys: str) -> str:
    return f"""SELECT {keys}, tp / nullif(tp + fn, 0)::DOUBLE AS recall, fp / nullif(fp + tn, 0)::DOUBLE AS fpr, (tp / nullif(tp + fn, 0)::DOUBLE + 1 - fp / nullif(fp + tn, 0)::DOUBLE) / 2 AS balanced_accuracy, a AS auroc
FROM (SELECT {keys}, count(*) FILTER (label = 1 AND decision = 1) AS tp, count(*) FILTER (label = 0 AND decision = 1) AS fp, count(*) FILTER (label = 0 AND decision = 0) AS tn, count(*) FILTER (label = 1 AND decision = 0) AS fn FROM p GROUP BY {keys})
LEFT JOIN (SELECT {keys}, avg(CASE WHEN u.score > v.score THEN 1.0 WHEN u.score = v.score THEN 0.5 ELSE 0 END) AS a FROM p u JOIN p v USING ({keys}) WHERE u.label = 1 AND v.label = 0 GROUP BY {keys}) USING ({keys})"""


_MEANS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in _NAMES)
_CUT = "CASE WHEN length({0}) <= 120 THEN {0} ELSE left({0}, {1}) || ' ... ' || right({0}, {2}) END"
_WORDS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "], w))"

QUERIES = {
    "metric_breakdowns": (_preds(lambda p: D.breakdowns(p, "unit", ["scenario"])), f"""
WITH {P}, p2 AS (SELECT *, 'all' AS pool FROM p), m AS ({_scored("unit")}), s AS ({_scored("scenario, unit")}), q AS ({_scored("pool").replace("FROM p ", "FROM p2 ").replace("JOIN p v", "JOIN p2 v")})
SELECT 'macro' AS kind, NULL AS name, {_MEANS}, count(*) AS units FROM m UNION ALL SELECT 'scenario', scenario, {_MEANS}, count(*) FROM s GROUP BY scenario UNION ALL SELECT 'pooled', NULL, {", ".join(f"round({n}, 6)" for n in _NAMES)}, 1 FROM q"""),
    "smallest_cell": (_preds(lambda p: D.smallest_cell(cell_metrics(p, ["unit", "scenario"]).withColumn("value", F.round("value", 6)), "value", "n", 2)), f"""
WITH {P}, c AS (SELECT unit, scenario, round(coalesce((count(*) FILTER (label = 1 AND decision = 1) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE + 1 - count(*) FILTER (label = 0 AND decision = 1) / nullif(count(*) FILTER (label = 0), 0)::DOUBLE) / 2, avg((label = decision)::INT)), 6) AS v, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT count(*) AS cells, min(v) AS least, arg_min(n, (v, n)) AS rows FROM c"""),
    "tie_diagnostics": (_preds(lambda p: D.tie_diagnostics(p, "unit")), f"""
WITH {P}, t AS (SELECT unit, avg((u.score = v.score)::INT) AS ties FROM p u JOIN p v USING (unit) WHERE u.label = 1 AND v.label = 0 GROUP BY unit), q AS (SELECT unit, quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM p GROUP BY unit)
SELECT unit, round(ties, 6) AS cross_ties, {", ".join(f"round(q[{k}], 6) AS d{k}" for k in range(1, 10))} FROM q LEFT JOIN t USING (unit)"""),
    "fit_errors": (_both(lambda j: D.fit_errors(j, "unit", "x", "y")), f"""
WITH {P}, {B}, {J}, s AS (SELECT unit, count(*) AS n, regr_sxx(y, x) AS a, regr_syy(y, x) AS c, regr_sxy(y, x) AS b FROM j GROUP BY unit) SELECT unit, n, round(CASE WHEN a > 0 THEN sqrt(greatest(0, c - b * b / a) / n) END, 6) AS rmse FROM s"""),
    "parity_counts": (_both(lambda j: D.parity_counts(j, "unit", "x", "y", 0.25)), f"WITH {P}, {B}, {J} SELECT unit, count(*) AS n, round(avg((sign(x - 0.25) = sign(y - 0.25))::INT), 6) AS same_side, count(*) FILTER (x = y) AS exact FROM j GROUP BY unit"),
    "teacher_sides": (_both(lambda j: D.teacher_sides(j.withColumnRenamed("d", "decision"), "e")), f"WITH {P}, {B}, {J} SELECT label, e = label AS teacher_right, count(*) AS n, count(*) FILTER (d <> label) AS errors FROM j GROUP BY 1, 2"),
    "vote_scores": (vote_scores, f"""
WITH {P}, m AS (SELECT index, score FROM p UNION ALL SELECT index, (index % 97) / 97.0::DOUBLE FROM p UNION ALL SELECT index, (index % 5) / 5.0::DOUBLE FROM p)
SELECT index, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(min(score), 6) AS least, round(max(score), 6) AS most FROM m WHERE index % 4 <> 0 GROUP BY 1"""),
    "rating_counts": (_preds(lambda p: D.rating_counts(p.withColumn("rating", F.pmod("index", F.lit(10))), "rating", 0, 9)), f"""
WITH {P}, c AS (SELECT index % 10 AS rating, label, count(*) AS n FROM p GROUP BY 1, 2) SELECT rating, label, n, round(n / sum(n) OVER (PARTITION BY label)::DOUBLE, 6) AS share, rating > 0 AND rating < 9 AS intermediate FROM c"""),
    "joint_status": (_both(lambda j: D.joint_status(j.select((F.col("d") == F.col("label")).alias("a"), (F.col("e") == F.col("label")).alias("b"), "label"), ["a", "b", "label"], [("a AND b", "keep"), ("a", "first"), ("b AND label = 1", "second")])), f"""
WITH {P}, {B}, {J}, s AS (SELECT d = label AS a, e = label AS b, label FROM j) SELECT a, b, label, count(*) AS n, CASE WHEN a AND b THEN 'keep' WHEN a THEN 'first' WHEN b AND label = 1 THEN 'second' ELSE 'review' END AS use FROM s GROUP BY 1, 2, 3"""),
    "usage_maps": (usage_maps, """
SELECT event_type, 'k' AS key, count(*) AS n, sum((props->>'k')::DOUBLE) AS total FROM events WHERE props->>'k' IS NOT NULL GROUP BY 1 UNION ALL SELECT event_type, 'calls', count(*), count(*)::DOUBLE FROM events WHERE props IS NOT NULL GROUP BY 1"""),
    "centred_correlation": (_both(lambda j: D.centred_correlation(j, "unit", "x", "y")), f"""
WITH {P}, {B}, {J}, c AS (SELECT x, y, x - avg(x) OVER (PARTITION BY unit) AS rx, y - avg(y) OVER (PARTITION BY unit) AS ry FROM j) SELECT round(corr(x, y), 6) AS raw, round(corr(rx, ry), 6) AS within, count(*) AS rows FROM c"""),
    "worst_units": (unparsed, f"""
WITH {P.replace("d.lang AS unit", "d.source AS unit")}, m AS ({with_confusion("(SELECT * FROM p WHERE index % 9 <> 0)", "unit")}), e AS (SELECT unit, count(*) FILTER (index % 9 = 0) AS unparsed FROM p GROUP BY 1)
SELECT unit, round(ba, 6) AS balanced_accuracy, unparsed FROM m JOIN e USING (unit) WHERE ba IS NOT NULL ORDER BY round(ba, 9), unit LIMIT 3"""),
    "reciprocal_fusion": (fused, f"""
WITH {P}, {B}, r AS (SELECT index, row_number() OVER (PARTITION BY unit ORDER BY score DESC, index) AS i FROM p UNION ALL SELECT index, row_number() OVER (PARTITION BY unit ORDER BY score DESC, index) FROM b) SELECT index, round(sum(1 / (60 + i)::DOUBLE), 6) AS fused FROM r GROUP BY 1"""),
    "scored_windows": (window_scores, """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS place FROM documents), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY place) AS b FROM l),
w AS (SELECT doc_id, place, 1 AS size, line AS t FROM n UNION ALL SELECT doc_id, place, 2, line || ' ' || b FROM n WHERE b IS NOT NULL), s AS (SELECT doc_id, size, place, round(len(regexp_extract_all(t, ',')) / 10.0::DOUBLE - 0.02 * (size - 1), 6) AS relevance FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size ORDER BY relevance DESC, place) AS rank FROM s) SELECT * FROM r WHERE rank <= 2"""),
    "coverage_reasons": (reasons, """
WITH a AS (SELECT DISTINCT doc_id, lang FROM documents), b AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN -doc_id ELSE doc_id END AS doc_id FROM labels WHERE doc_id % 3 <> 0)
SELECT CASE WHEN a.doc_id IS NULL THEN 'only_second' WHEN b.doc_id IS NULL THEN 'only_first' ELSE 'both' END AS relation, CASE WHEN a.doc_id IS NULL THEN 'label' WHEN b.doc_id IS NULL THEN lang END AS reason, count(*) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1, 2"""),
    "cache_rules": (cache_rules, """
WITH j AS (SELECT * FROM documents JOIN labels USING (doc_id)) SELECT 'no_text' AS rule, count(*) FILTER (text IS NULL) AS violations FROM j UNION ALL SELECT 'empty', count(*) FILTER (length(text) = 0) FROM j UNION ALL SELECT 'length', count(*) FILTER (n_chars <> length(text)) FROM j
UNION ALL SELECT 'language', count(*) FILTER (lang NOT IN ('en', 'de', 'fr', 'es')) FROM j UNION ALL SELECT 'toxic_good', count(*) FILTER (toxic = 1 AND quality = 1) FROM j"""),
    "member_targets": (member_targets, f"""
WITH {P}, m AS (SELECT index, label, member, [0.5, 0.25, 0.25][((index + member) % 3 + 1)::INT] AS p FROM p, (SELECT unnest([0, 1, 2]) AS member) WHERE index % 11 <> 0 OR member > 0),
g AS (SELECT index, count(*) AS n, sum(CASE WHEN index % 7 = 0 AND member = 2 THEN 0.1 ELSE p END) AS mass, arg_max(member, (CASE WHEN index % 7 = 0 AND member = 2 THEN 0.1 ELSE p END, -member)) AS w FROM m GROUP BY 1), s AS (SELECT index, w, CASE WHEN n <> 3 THEN 'members' WHEN abs(mass - 1) > 1e-9 THEN 'mass' WHEN index % 13 = 0 THEN 'labels' END AS problem FROM g)
SELECT index, CASE WHEN problem IS NULL THEN w END AS winner, problem FROM s"""),
    "seen_groups": (seen_groups, f"""
WITH {P}, g AS (SELECT *, ('0x' || sha256('group' || chr(31) || scenario || '|' || unit)[1:13])::BIGINT::DOUBLE / 4503599627370496.0 < 0.3 AS test FROM p)
SELECT CASE WHEN scenario IN (SELECT scenario FROM g WHERE NOT test) THEN 'seen' ELSE 'novel' END AS kind, count(*) AS n, sum(index)::BIGINT AS rows FROM g WHERE test GROUP BY 1"""),
    "full_sample": (full_sample, f"""
WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY label, scenario ORDER BY sha256('rr' || chr(31) || index), index) AS i FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY i, scenario) AS k FROM r) SELECT index, label FROM t WHERE k <= 10"""),
    "exclusive_routes": (routes, """
WITH h AS (SELECT list_filter([CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'digits' END], lambda x: x IS NOT NULL) AS h FROM documents) SELECT coalesce(h[1], 'none') AS route, count(*) AS n, count(*) FILTER (len(h) > 1) AS overlaps FROM h GROUP BY 1"""),
    "dialogue_views": (views, f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations), v AS (SELECT conv_id, coalesce(string_agg(t, chr(10) ORDER BY turn, t) FILTER (role = 'user'), '') AS u, coalesce(string_agg(t, chr(10) ORDER BY turn, t) FILTER (role = 'assistant'), '') AS a,
coalesce(arg_min(t, (turn, t)) FILTER (role = 'user'), '') AS f, coalesce(arg_max(t, (turn, t)) FILTER (role = 'user'), '') AS l FROM t GROUP BY 1)
SELECT conv_id, md5({_CUT.format("u", 30, 90)}) AS user, md5({_CUT.format("a", 90, 30)}) AS assistant, md5({_CUT.format("f", 40, 80)}) AS first_user, md5({_CUT.format("l", 60, 60)}) AS last_user FROM v"""),
    "sanitised_turns": (sanitised, "SELECT role, count(*) AS n, sum(length(regexp_replace(text, '(?i)th[a-z]*', '[removed]', 'g')))::BIGINT AS chars FROM conversations GROUP BY 1"),
    "repaired_texts": (_docs(repairs), "SELECT doc_id, md5('<p> &amp; ' || regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FFFD}]', '', 'g') || ' – ') AS plain, md5(text || chr(65533) || lang) AS valid FROM documents WHERE text IS NOT NULL"),
    "last_fields": (_docs(fields), "SELECT doc_id, (doc_id % 10)::VARCHAR AS rating, 'no' AS prediction, NULL AS verdict FROM documents"),
    "heading_free": (_docs(heading_free), rf"""
WITH s AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '[=#]', '', 'g'), '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: length(x) >= 20) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(s)::INT AS n FROM s"""),
    "key_terms": (lambda s, d: read(s, d, "benchmark").select("item_id", F.array_join(X.key_terms(F.col("text"), limit=5), " ").alias("terms")), f"""
WITH w AS (SELECT item_id, {_WORDS} AS w FROM benchmark) SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5], ' ') AS terms FROM w"""),
    "folded_first": (_docs(folded_first), r"SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g'))"),
    "site_sentences": (page_lines, None),
    "recovered_rows": (found_rows, None),
}

