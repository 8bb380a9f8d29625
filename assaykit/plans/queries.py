"""Queries over the test tables, one or more per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import stable_fraction
from ..operators import conversations, joins, metrics, retrieval, sampling
from ..sources.tables import ledger, predictions, read, second_predictions
from ..streaming.windows import event_windows
from . import breakdowns, comparisons, evaluation, knowledge, learning, parsing, relations, scans, selection, texts, variants
from .common import B, P, rounded

def _preds(make):
    return lambda spark, sf: rounded(make(predictions(spark, sf)))


_R = "round({0}, 6)"
_SQUEEZED = r"trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ')"


_SENTENCES = (
    "WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace("
    + _SQUEEZED.replace("lower(text)", "text")
    + r""", '([.!?]) ([A-Z0-9"''(])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda s: length(s) >= {least}) AS s FROM documents),
x AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS place FROM t)
SELECT doc_id, md5(arg_min(sentence, place)) AS digest, min(place)::INT AS place FROM x WHERE length(sentence) <= 900 GROUP BY doc_id, lower(sentence)"""
)
_CONTAINED = f"""
WITH d AS (SELECT doc_id, {_SQUEEZED} AS t FROM documents), b AS (SELECT item_id, {_SQUEEZED} AS t FROM benchmark),
m AS (SELECT item_id, doc_id FROM b JOIN d ON contains(d.t, b.t) OR contains(b.t, d.t) WHERE d.t <> '' AND b.t <> '')"""


def _confusion(by: str, table: str = "p", label: str = "label") -> str:
    return f"c AS (SELECT {by}, count(*) FILTER ({label} = 1 AND decision = 1) AS tp, count(*) FILTER ({label} = 0 AND decision = 1) AS fp, count(*) FILTER ({label} = 0 AND decision = 0) AS tn, count(*) FILTER ({label} = 1 AND decision = 0) AS fn FROM {table} GROUP BY {by})"


_RATES = "m AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE END AS fpr FROM c)"
_AUC = "a AS (SELECT x.unit, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS auroc FROM p x JOIN p y ON x.unit = y.unit AND x.label = 1 AND y.label = 0 GROUP BY x.unit)"
_DIGEST = "sha256('{seed}' || chr(31) || index)"


def _digest(seed: str) -> str:
    return _DIGEST.format(seed=seed)


def unit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.score_units(predictions(spark, sf_dir)))


def sentence_rows(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    s = retrieval.page_sentences(read(spark, sf_dir, "documents"), "doc_id", "text", least)
    return s.select("doc_id", F.md5("sentence").alias("digest"), "place")


def contained(spark: SparkSession, sf_dir: str, match) -> DataFrame:
    return match(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items with one first line; of documents that hold an item from their first line on."""
    titled = lambda t: read(spark, sf_dir, t).withColumn("title", F.substring_index("text", "\n", 1))
    return retrieval.source_matches(titled("documents"), titled("benchmark"), "doc_id", "title", "text", "item_id", "title", "text")


def big_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("unit"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.floor("o_totalprice").alias("score"))
    return rounded(metrics.auroc(o, ["unit"]))


def stage_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim"), F.col("l_linenumber").alias("stage")).agg(F.min("l_returnflag").alias("answer"))
    return joins.prefer_decisive(lines.withColumn("decisive", F.col("answer") != "N"), "claim")


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per event type and day."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def turn_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation shape: turns, last assistant answer, characters per role."""
    t = read(spark, sf_dir, "conversations")
    n = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.length("text"))), F.lit(0))
    return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), n("user").alias("user_chars"), n("assistant").alias("assistant_chars"), F.max_by("role", "turn").alias("last_role"), F.min("turn").alias("first_turn"))


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 10).select("item_id", "doc_id", "score", "rank")


def _sampled(make, *columns):
    return lambda spark, sf: make(predictions(spark, sf)).select("index", *columns)


def _two(make):
    def run(spark, sf):
        p = predictions(spark, sf)
        return rounded(make(p, second_predictions(p)))

    return run


_QUERIES = {
    "unit_metrics": (unit_metrics, f"""
WITH {P}, {_confusion('unit')}, {_RATES}, {_AUC} SELECT unit, tp, fp, tn, fn, {_R.format('recall')} AS recall, {_R.format('fpr')} AS fpr, {_R.format('(recall + 1 - fpr) / 2')} AS balanced_accuracy, {_R.format('auroc')} AS auroc FROM m LEFT JOIN a USING (unit)
"""),
    "macro_metrics": (_preds(lambda p: metrics.macro_mean(metrics.score_units(p))), f"""
WITH {P}, {_confusion('unit')}, {_RATES}, {_AUC} SELECT round(avg(recall), 6) AS recall, round(avg(fpr), 6) AS fpr, round(avg((recall + 1 - fpr) / 2), 6) AS balanced_accuracy, round(avg(auroc), 6) AS auroc, count(*) AS units FROM m LEFT JOIN a USING (unit)
"""),
    "cell_metrics": (_preds(lambda p: metrics.cell_metrics(p, ["unit", "scenario"])), f"""
WITH {P}, {_confusion('unit, scenario')}, {_RATES} SELECT unit, scenario, round(coalesce((recall + 1 - fpr) / 2, (tp + tn) / (tp + fp + tn + fn)::DOUBLE), 6) AS value, tp + fp + tn + fn AS n FROM m
"""),
    "big_auroc": (big_auroc, """
WITH o AS (SELECT o_orderpriority AS unit, (o_orderstatus = 'F')::INT AS label, floor(o_totalprice) AS score FROM orders),
r AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY score) + (count(*) OVER (PARTITION BY unit, score) - 1) / 2.0 AS rk FROM o),
s AS (SELECT unit, sum(rk) FILTER (label = 1) AS w, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r GROUP BY unit)
SELECT unit, CASE WHEN p * n > 0 THEN round((w - p * (p + 1) / 2.0) / (p * n), 6) END AS auroc FROM s
"""),
    "threshold_sweep": (_preds(metrics.threshold_sweep), f"""
WITH {P},
g AS (SELECT unnest(range(0, 101))::INT AS bin),
u AS (SELECT unit, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM p GROUP BY unit HAVING count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0),
t AS (SELECT u.unit, bin, pos, neg, (SELECT count(*) FROM p WHERE p.unit = u.unit AND label = 1 AND floor(score * 100)::INT >= bin) AS tp, (SELECT count(*) FROM p WHERE p.unit = u.unit AND label = 0 AND floor(score * 100)::INT >= bin) AS fp FROM u, g)
SELECT bin, round(avg((tp / pos::DOUBLE + 1 - fp / neg::DOUBLE) / 2), 6) AS macro_ba, round(avg(fp / neg::DOUBLE), 6) AS macro_fpr FROM t GROUP BY bin
"""),
    "top_fraction": (_sampled(lambda p: metrics.top_fraction(p, 0.25), "unit", "top"), f"""
WITH {P},
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, index) AS rn, count(*) OVER (PARTITION BY unit) AS n FROM p)
SELECT index, unit, (rn <= round_even(0.25 * n, 0))::INT AS top FROM r
"""),
    "paired_changes": (_two(metrics.paired_changes), f"""
WITH {P}, {B} SELECT p.unit, count(*) FILTER (p.decision <> b.decision) AS changed, count(*) FILTER (p.decision <> b.decision AND b.decision = p.label) AS fixes, count(*) FILTER (p.decision <> b.decision AND p.decision = p.label) AS breaks FROM p JOIN b USING (index) GROUP BY p.unit
"""),
    "correlations": (_preds(lambda p: metrics.correlations(p.withColumn("z", F.pmod("index", F.lit(97)).cast("double")), "unit", "score", "z")), f"""
WITH {P},
q AS (SELECT unit, score, (index % 97)::DOUBLE AS z FROM p),
r AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY score) + (count(*) OVER (PARTITION BY unit, score) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY unit ORDER BY z) + (count(*) OVER (PARTITION BY unit, z) - 1) / 2.0 AS ry FROM q)
SELECT unit, round(corr(score, z), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY unit
"""),
    "affine_fit": (_preds(lambda p: metrics.affine_fit(p.withColumn("z", F.pmod("index", F.lit(97)).cast("double")), "unit", "score", "z")), f"""
WITH {P} SELECT unit, round(regr_slope((index % 97)::DOUBLE, score), 6) AS slope, round(regr_intercept((index % 97)::DOUBLE, score), 6) AS intercept, round(regr_r2((index % 97)::DOUBLE, score), 6) AS r2 FROM p GROUP BY unit
"""),
    "error_summary": (_two(lambda a, b: metrics.error_summary(a.join(b.select("index", F.col("score").alias("other")), "index"), "unit", "score", "other")), f"""
WITH {P}, {B},
d AS (SELECT p.unit, abs(p.score - b.score) AS e FROM p JOIN b USING (index))
SELECT unit, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(e, 0.5), 6) AS median, round(max(e), 6) AS most, count(*) FILTER (e <= 1e-6) AS close FROM d GROUP BY unit
"""),
    "cell_weights": (_preds(lambda p: metrics.cell_weights(p, ["unit", "label"])), f"""
WITH {P},
c AS (SELECT unit, label, count(*) AS rows FROM p GROUP BY unit, label)
SELECT unit, label, rows, round((SELECT sum(rows) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * rows), 6) AS weight FROM c
"""),
    "pair_order": (_preds(metrics.pair_order), f"""
WITH {P} SELECT u.unit, count(*) FILTER (x.score > y.score) AS above, count(*) FILTER (x.score = y.score) AS ties, count(*) FILTER (x.score < y.score) AS under FROM (SELECT DISTINCT unit FROM p) u LEFT JOIN p x ON x.unit = u.unit AND x.label = 1 LEFT JOIN p y ON y.unit = u.unit AND y.label = 0 GROUP BY u.unit
"""),
    "margin_bins": (_preds(lambda p: metrics.margin_bins(p.withColumn("m", F.pmod("index", F.lit(15)) / 2 - 3.5), "m")), f"""
WITH {P},
q AS (SELECT *, abs(index % 15 / 2.0 - 3.5) AS m FROM p)
SELECT CASE WHEN m < 1 THEN '[0,1)' WHEN m < 3 THEN '[1,3)' WHEN m < 5 THEN '[3,5)' ELSE '[5,inf)' END AS bin, count(*) AS n, count(*) FILTER (label <> decision) AS errors FROM q GROUP BY 1
"""),
    "error_cases": (_preds(lambda p: metrics.error_cases(p, 10)), f"""
WITH {P},
k AS (SELECT *, CASE WHEN label = 1 AND decision = 0 THEN 'fn' WHEN label = 0 AND decision = 1 THEN 'fp' END AS kind FROM p),
r AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'fn' THEN score ELSE -score END, index)::INT AS rank, index, round(score, 6) AS score FROM k WHERE kind IS NOT NULL)
SELECT * FROM r WHERE rank <= 10
"""),
    "rating_audit": (_preds(lambda p: metrics.rating_audit(p.withColumn("rating", F.pmod("index", F.lit(10))), "rating")), f"""
WITH {P},
c AS (SELECT label, index % 10 AS rating, count(*) AS c FROM p GROUP BY 1, 2),
q AS (SELECT *, c / sum(c) OVER (PARTITION BY label)::DOUBLE AS pr FROM c)
SELECT label, sum(c)::BIGINT AS n, count(*) AS ratings, round(-sum(pr * log2(pr)), 6) AS entropy FROM q GROUP BY label
"""),
    "leaderboard": (lambda s, d: rounded(metrics.leaderboard(ledger(s, d))), """
WITH r AS (SELECT o_custkey % 20 AS team, o_orderpriority AS notebook, o_orderdate AS submitted_at, CASE WHEN o_orderkey % 53 <> 0 THEN o_totalprice / 600000 END AS metric, o_orderkey % 53 <> 0 AS ok FROM orders),
s AS (SELECT team, notebook, submitted_at, bool_and(ok) AS ok, sum(metric::DECIMAL(28, 12))::DOUBLE / count(metric) AS value, count(*) AS units FROM r GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY team, notebook ORDER BY value DESC, submitted_at) AS rn FROM s WHERE ok)
SELECT team, notebook, submitted_at, round(value, 6) AS value, units FROM t WHERE rn = 1
"""),
    "exclude_used": (lambda s, d: joins.exclude_used(read(s, d, "documents").select("doc_id", "lang"), [read(s, d, "labels")], "doc_id"), "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "common_keys": (lambda s, d: joins.common_keys([read(s, d, "labels").select("doc_id", "quality"), read(s, d, "labels").filter("toxic = 0").select("doc_id", "quality")], "doc_id", "quality"), "SELECT doc_id, quality FROM labels WHERE toxic = 0"),
    "coverage_diff": (lambda s, d: joins.coverage_diff(read(s, d, "labels"), read(s, d, "documents").filter("lang = 'en'"), "doc_id"), """
WITH a AS (SELECT DISTINCT doc_id, 1 AS a FROM labels),
b AS (SELECT DISTINCT doc_id, 1 AS b FROM documents WHERE lang = 'en')
SELECT CASE WHEN a IS NULL THEN 'lost' WHEN b IS NULL THEN 'new' ELSE 'both' END AS kind, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1
"""),
    "stage_preference": (stage_preference, """
WITH s AS (SELECT l_orderkey AS claim, l_linenumber AS stage, min(l_returnflag) AS answer FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY answer = 'N', stage) AS rn FROM s)
SELECT claim, stage, answer FROM r WHERE rn = 1
"""),
    "label_null": (lambda s, d: rounded(joins.label_null(predictions(s, d)).select("index", "score", "shifted")), f"""
WITH {P} SELECT index, round(score, 6) AS score, round(coalesce(lead(score) OVER w, first_value(score) OVER w), 6) AS shifted FROM p WINDOW w AS (PARTITION BY label ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""),
    "compose_routes": (_two(lambda a, b: joins.compose_routes(a, b, F.col("unit") == "de").select("index", "unit", "score")), f"WITH {P}, {B} SELECT index, p.unit, round(CASE WHEN p.unit = 'de' THEN b.score ELSE p.score END, 6) AS score FROM p JOIN b USING (index)"),
    "retry_set": (lambda s, d: joins.retry_set(read(s, d, "documents").select("doc_id"), read(s, d, "labels").withColumn("complete", F.col("toxic") == 0), 1, "doc_id"), """
SELECT doc_id, coalesce(c, 0) AS complete FROM documents LEFT JOIN (SELECT doc_id, count(*) FILTER (toxic = 0) AS c FROM labels GROUP BY 1) USING (doc_id) WHERE coalesce(c, 0) < 1
"""),
    "one_to_one": (_two(lambda a, b: joins.join_one_to_one(a.select("index", "label", "score"), b.select("index", "label", F.col("score").alias("other")), ["index"])), f"WITH {P}, {B} SELECT index, p.label, round(p.score, 6) AS score, round(b.score, 6) AS other FROM p JOIN b USING (index)"),
    "sample_fraction": (_sampled(lambda p: sampling.sample_fraction(p, 0.2, ["unit", "label"]), "unit", "label"), f"""
WITH {P},
r AS (SELECT *, row_number() OVER (PARTITION BY unit, label ORDER BY {_digest('s')}, index) AS rn, count(*) OVER (PARTITION BY unit, label) AS n FROM p)
SELECT index, unit, label FROM r WHERE rn <= greatest(1, floor(n * 0.2::DOUBLE + 0.5))
"""),
    "round_robin_sample": (_sampled(lambda p: sampling.round_robin_sample(p, 50, "label", "scenario"), "label", "scenario"), f"""
WITH {P},
r AS (SELECT *, row_number() OVER (PARTITION BY label, scenario ORDER BY {_digest('rr')}, index) AS i FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY i, scenario) AS rn FROM r)
SELECT index, label, scenario FROM t WHERE rn <= 50
"""),
    "shard": (_sampled(lambda p: sampling.shard(p, 4, ["unit", "label"]), "shard"), f"WITH {P} SELECT index, ((row_number() OVER (PARTITION BY unit, label ORDER BY {_digest('shard')}, index) - 1) % 4)::INT AS shard FROM p"),
    "limit_per": (_sampled(lambda p: sampling.limit_per(p, 3, ["scenario"]), "scenario"), f"""
WITH {P},
r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY {_digest('limit')}, index) AS rn FROM p)
SELECT index, scenario FROM r WHERE rn <= 3
"""),
    "half_split": (_sampled(lambda p: sampling.half_split(p, ["unit", "label"]), "half"), f"""
WITH {P},
r AS (SELECT *, row_number() OVER (PARTITION BY unit, label ORDER BY {_digest('half')}, index) AS rn, count(*) OVER (PARTITION BY unit, label) AS n FROM p)
SELECT index, CASE WHEN rn <= n // 2 THEN 1 ELSE 2 END AS half FROM r
"""),
    "split3": (_sampled(lambda p: sampling.split3(p, (0.8, 0.1, 0.1), ["unit", "label"]), "split"), None),
    "uncertain_fraction": (_sampled(lambda p: sampling.uncertain_fraction(p, 0.1, 0.1, ["unit"]), "unit"), f"""
WITH {P},
r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY abs(score - 0.1::DOUBLE), {_digest('u')}) AS rn, count(*) OVER (PARTITION BY unit) AS n FROM p)
SELECT index, unit FROM r WHERE rn <= greatest(1, floor(n * 0.1::DOUBLE + 0.5))
"""),
    "group_folds": (_sampled(lambda p: sampling.group_folds(p, "scenario"), "fold"), f"WITH {P} SELECT index, ('0x' || sha256('fold' || chr(31) || scenario)[1:13])::BIGINT % 5 AS fold FROM p"),
    "hash_fraction": (_sampled(lambda p: p.withColumn("u", F.round(stable_fraction("drop", "index"), 6)), "u"), f"WITH {P} SELECT index, round(('0x' || sha256('drop' || chr(31) || index)[1:13])::BIGINT::DOUBLE / 4503599627370496.0, 6) AS u FROM p"),
    "sentences": (lambda s, d: sentence_rows(s, d, 20), _SENTENCES.format(least=20)),
    "page_sentences": (lambda s, d: sentence_rows(s, d, 32), _SENTENCES.format(least=32)),
    "search_bm25": (search, """
WITH t AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM documents),
tf AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term <> '' GROUP BY 1, 2),
sz AS (SELECT doc_id, sum(tf) AS size FROM tf GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + ((SELECT count(*) FROM documents WHERE text IS NOT NULL) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / (SELECT avg(size) FROM sz)))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN sz USING (doc_id) WHERE term <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10
"""),
    "line_matches": (lambda s, d: contained(s, d, retrieval.line_matches), f"{_CONTAINED} SELECT item_id, count(DISTINCT doc_id) AS docs FROM m GROUP BY 1"),
    "source_matches": (sources, f"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS h, {_SQUEEZED} AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS h, {_SQUEEZED} AS t FROM benchmark)
SELECT DISTINCT item_id, doc_id FROM b JOIN d USING (h) WHERE h <> '' AND d.t <> '' AND b.t <> '' AND (contains(d.t, b.t) OR contains(b.t, d.t))"""),
    "text_containment": (lambda s, d: contained(s, d, retrieval.text_containment), f"{_CONTAINED} SELECT DISTINCT item_id, doc_id FROM m"),
    "usage_totals": (usage_totals, "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"),
    "turn_shapes": (turn_shapes, """
SELECT conv_id, count(*) AS turns, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS user_chars, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_chars, arg_max(role, turn) AS last_role, min(turn) AS first_turn FROM conversations GROUP BY 1
"""),
    "merge_turns": (lambda s, d: conversations.merge_turns(read(s, d, "conversations")).select("conv_id", "island", "role", "turns", F.md5("text").alias("digest")), """
WITH a AS (SELECT *, (lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role)::INT AS ch FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)),
b AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT conv_id, island::BIGINT AS island, role, count(*) AS turns, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM b GROUP BY conv_id, island, role
"""),
    "final_turn": (lambda s, d: conversations.final_turn(read(s, d, "conversations"), "assistant").select("conv_id", F.md5("text").alias("digest")), """
WITH l AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(text, '') DESC) AS rn FROM conversations WHERE role = 'assistant')
SELECT conv_id, md5(coalesce(l.text, '')) AS digest FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN l USING (conv_id) WHERE coalesce(rn, 1) = 1
"""),
    "event_windows": (lambda s, d: event_windows(read(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 3).alias("total")), "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2"),
}


_ALL = _QUERIES
for _part in (evaluation, selection, comparisons, relations, parsing, scans, learning, knowledge, breakdowns, texts, variants):
    _ALL = _ALL | _part.QUERIES


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict:
    fixed = {name: sql for name, (_, sql) in _ALL.items() if isinstance(sql, str)}
    return fixed | {name: sql() for name, (_, sql) in _ALL.items() if callable(sql)}
