"""Queries of learning on tables; SQL where no iterative fit is part of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrowtext import cut
from ..functions.parsing import terms
from ..functions.scalar import squeezed
from ..operators import learning as L
from ..operators import nested, ranking
from ..operators.knowledge import candidate_features
from ..operators.metrics import auroc
from ..sources.tables import predictions, read
from .common import B, P, rounded
from .comparisons import J, both
from .knowledge import FIELDS, RERANK, halves, sentence_pages

WEIGHTS = [0.25, 0.5, 0.75]
SHAPES = ["a", "b", "c", "d"]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("lang").alias("unit"), F.col("doc_id").alias("index"), F.coalesce("text", F.lit("")).alias("text"), F.col("quality").alias("label"))


def _digested(weights: DataFrame, key: str) -> DataFrame:
    """Of each row the number of its terms, their weights' sum and the term of the greatest weight."""
    best = F.max_by("term", F.struct(F.round("weight", 9), "term"))
    return rounded(weights.groupBy(key).agg(F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("total"), best.alias("best")))


def word_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.word_tfidf(read(spark, sf_dir, "benchmark"), "item_id", "text"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digested(L.word_tfidf(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by a logistic model of 5,000 words and pairs, rows weighted so that both labels count alike."""
    rows = _labelled(spark, sf_dir)
    vectors, _ = L.term_vectors(L.word_tfidf(rows, "index", "text", features=5000), "index", 5000)
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.create_map(*[x for y, c in n.items() for x in (F.lit(y), F.lit(sum(n.values()) / (2.0 * c)))])[F.col("label")]
    table = cut(vectors.join(rows.select("index", "unit", "label"), "index").withColumn("w", weight))
    model = L.fit_logistic(table, "features", "label", weight="w")
    return L.scored(model, table).select("index", "unit", "label", F.round("oof", 4).alias("score"))


def char_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.char_tfidf(read(spark, sf_dir, "benchmark"), "item_id", "text"))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    share = lambda p: F.regexp_count(t, F.lit(p)) / (F.length(t) + 1)
    rows = _labelled(spark, sf_dir).select("unit", "index", "label", F.log1p(F.length(t)).alias("a"), (share("[0-9]") * 10).alias("b"), (share("[.!?]") * 10).alias("c"), (share("[A-Z]") * 10).alias("d"))
    return L.assembled(rows, SHAPES)


def logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shapes(spark, sf_dir)
    model = L.fit_logistic(rows, "features", "label")
    return L.scored(model, rows).select("index", F.round("oof", 4).alias("score"))


def group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language by the others' model of four shares; all models in one pass a step."""
    rows = _shapes(spark, sf_dir)
    oof = nested.grouped_oof(rows, "index", "unit", SHAPES, "label")
    return oof.join(rows.select("index", "unit"), "index").select("index", "unit", F.round("oof", 4).alias("score"))


def nested_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language by the others' model, whose C is chosen among those others."""
    oof = nested.nested_oof(_shapes(spark, sf_dir), "index", "unit", SHAPES, "label", [0.01, 0.1, 1.0, 10.0], balanced=True)
    return oof.select("index", "c", F.round("oof", 4).alias("score"))


def nested_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language by the blend or gate of two scores that is best over the others."""
    rows = both(spark, sf_dir)
    blends = {f"blend {w:g}": (1 - w) * F.col("x") + w * F.col("y") for w in WEIGHTS}
    return rounded(L.nested_choice(rows, "unit", "index", blends | L.gates("x", "y", [0.1, 0.3])))


def length_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.length_control(_labelled(spark, sf_dir), "unit", "text").select("index", "unit", F.round("oof", 4).alias("score"))


def nested_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.nested_blend(both(spark, sf_dir), "unit", "index", "x", "y", [0.0, *WEIGHTS, 1.0]))


def chosen_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and weight the results of a blend; the best by AUROC, then the smaller weight."""
    grid = L.blend_grid(both(spark, sf_dir), ["scenario"], "x", "y", WEIGHTS)
    return rounded(L.grid_select(grid, [F.desc_nulls_last(F.round("auroc", 9)), F.asc("weight")], ["scenario"]))


def family_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.select_parameters(both(spark, sf_dir).withColumn("family", F.pmod("index", F.lit(3))), "family", "unit", "x", "y", WEIGHTS, 0.001, 0.5, -0.2))


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    vectors, names = L.term_vectors(L.word_tfidf(rows, "index", "text", features=2000), "index", 2000)
    model = L.fit_logistic(cut(vectors.join(rows.select("index", "label"), "index")), "features", "label")
    return spark.createDataFrame([(t, round(v, 4)) for t, v in L.top_features(model, names, 10)], "term string, coefficient double")


def probe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumn("fold", F.pmod("vec_id", F.lit(2)))
    return L.embedding_probe(e.withColumn("y", (F.col("label") % 2 == 0).cast("int")), "fold", "embedding", "y").select("vec_id", F.round("oof", 3).alias("score"))


def routed_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.router(read(spark, sf_dir, "documents"), "doc_id", "text", "lang"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that search finds for an item, right where the item's text holds them, with their eleven features and the terms they share."""
    found = candidate_features(sentence_pages(spark, sf_dir), halves(spark, sf_dir), "doc_id", "sid", "item_id", FIELDS, 20)
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    rows = found.join(items, "item_id")
    held = F.contains(squeezed(F.col("item")), squeezed(F.col("text")))
    shared = F.transform(F.array_intersect(terms(F.col("item")), terms(F.col("text"))), lambda t: F.struct(F.concat(F.lit("both="), t).alias("name"), F.lit(1.0).alias("value")))
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in RERANK])
    return cut(rows.select("item_id", "sid", *RERANK, held.cast("int").alias("label"), F.concat(named, shared).alias("features")))


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by a logistic model of the eleven features, with a threshold from held-out questions."""
    out, threshold = L.fit_reranker(_candidates(spark, sf_dir).drop("features"), "item_id", list(RERANK), "label")
    return out.select("item_id", "sid", "label", F.round("rerank", 3).alias("score"), (F.col("rerank") >= threshold).cast("int").alias("kept"))


def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the hashed ranker puts a right sentence first or among the first five, by side."""
    out, threshold = ranking.fit_ranker(_candidates(spark, sf_dir).select("item_id", "sid", "label", "features"), "item_id", "sid")
    return rounded(ranking.ranking_report(out, "item_id", 5, threshold))


def label_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(auroc(predictions(spark, sf_dir), ["scenario"]))


_NORM = "SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w"
_WEIGHT = "n AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.98 * (SELECT n FROM n) ORDER BY df DESC, term LIMIT {0}), w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)::DOUBLE) + 1) AS w FROM c JOIN d USING (term), n)"


def _grid(by: str, weights: list[float]) -> str:
    return f"""k AS (SELECT j.*, index % 3 AS family, w, round((1 - w) * x + w * y, 9) AS s FROM j, (SELECT unnest({weights})::DOUBLE AS w)),
g AS (SELECT {by}, u.w, avg(CASE WHEN u.s > v.s THEN 1.0 WHEN u.s = v.s THEN 0.5 ELSE 0 END) AS auroc FROM k u JOIN k v USING ({by}) WHERE u.w = v.w AND u.label = 1 AND v.label = 0 GROUP BY {by}, u.w)"""


QUERIES = {
    "word_tfidf": (word_weights, rf"""
WITH t AS (SELECT item_id, regexp_extract_all(translate(lower(coalesce(text, '')), '{L.ACCENTS[0]}', '{L.ACCENTS[1]}'), '[a-z0-9]{{2,}}') AS w FROM benchmark),
x AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t), c AS (SELECT item_id, term, count(*) AS tf FROM x GROUP BY 1, 2), {_WEIGHT.format(20000)} {_NORM}"""),
    "char_tfidf": (char_weights, rf"""
WITH t AS (SELECT item_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda v: v <> '')) || ' ' AS p FROM benchmark),
x AS (SELECT item_id, unnest(list_concat(list_concat(list_transform(range(1, greatest(1, length(p) - 1)), lambda i: substr(p, i, 3)), list_transform(range(1, greatest(1, length(p) - 2)), lambda i: substr(p, i, 4))), list_transform(range(1, greatest(1, length(p) - 3)), lambda i: substr(p, i, 5)))) AS term FROM t),
c AS (SELECT item_id, term, count(*) AS tf FROM x GROUP BY 1, 2), {_WEIGHT.format(50000)} {_NORM}"""),
    "document_words": (document_words, rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(lower(coalesce(text, '')), '{L.ACCENTS[0]}', '{L.ACCENTS[1]}'), '[a-z0-9]{{2,}}') AS w FROM documents),
x AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t), c AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY 1, 2), {_WEIGHT.format(20000).replace("benchmark", "documents").replace("item_id", "doc_id")},
v AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
SELECT doc_id, count(*) AS terms, round(sum(weight), 6) AS total, arg_max(term, (round(weight, 9), term)) AS best FROM v GROUP BY 1"""),
    "text_scores": (text_scores, None),
    "nested_scores": (nested_scores, None),
    "nested_gates": (nested_gates, f"""
WITH {P}, {B}, {J}, q AS (SELECT 0 AS i, 'blend 0.25' AS choice UNION ALL SELECT 1, 'blend 0.5' UNION ALL SELECT 2, 'blend 0.75' UNION ALL SELECT 3, 'gate 0.1' UNION ALL SELECT 4, 'gate 0.3'),
k AS (SELECT j.*, i, choice, round(CASE i WHEN 0 THEN 0.75 * x + 0.25 * y WHEN 1 THEN 0.5 * x + 0.5 * y WHEN 2 THEN 0.25 * x + 0.75 * y WHEN 3 THEN CASE WHEN abs(x - 0.5) < 0.1 THEN y ELSE x END ELSE CASE WHEN abs(x - 0.5) < 0.3 THEN y ELSE x END END, 9) AS s FROM j, q),
g AS (SELECT u.unit, u.i, avg(CASE WHEN u.s > v.s THEN 1.0 WHEN u.s = v.s THEN 0.5 ELSE 0 END) AS auroc FROM k u JOIN k v ON u.unit = v.unit AND u.i = v.i AND u.label = 1 AND v.label = 0 GROUP BY 1, 2),
m AS (SELECT u.unit, g.i, round(avg(auroc), 9) AS a FROM (SELECT DISTINCT unit FROM j) u JOIN g ON g.unit <> u.unit GROUP BY 1, 2), best AS (SELECT unit, arg_max(i, (a, -i)) AS i FROM m GROUP BY 1)
SELECT index, choice, round(s, 6) AS oof FROM k JOIN best USING (unit, i)"""),
    "logistic_scores": (logistic_scores, None),
    "group_scores": (group_scores, None),
    "length_scores": (length_scores, None),
    "nested_blend": (nested_blend, f"""
WITH {P}, {B}, {J}, {_grid("unit", [0.0, *WEIGHTS, 1.0])}, m AS (SELECT u.unit, g.w, round(avg(auroc), 9) AS a FROM (SELECT DISTINCT unit FROM j) u JOIN g ON g.unit <> u.unit GROUP BY 1, 2),
best AS (SELECT unit, arg_max(w, (a, -w)) AS w FROM m GROUP BY 1) SELECT index, w AS weight, round((1 - w) * x + w * y, 6) AS oof FROM j JOIN best USING (unit)"""),
    "chosen_parameters": (chosen_parameters, f"""
WITH {P}, {B}, {J}, {_grid("scenario", WEIGHTS)}, r AS (SELECT s.scenario, w.w, auroc, row_number() OVER (PARTITION BY s.scenario ORDER BY round(auroc, 9) DESC NULLS LAST, w.w) AS i FROM (SELECT DISTINCT scenario FROM j) s, (SELECT unnest({WEIGHTS})::DOUBLE AS w) w LEFT JOIN g ON g.scenario = s.scenario AND g.w = w.w)
SELECT scenario, w AS weight, round(auroc, 6) AS auroc FROM r WHERE i = 1"""),
    "family_parameters": (family_parameters, f"""
WITH {P}, {B}, {J}, {_grid("family, unit", [0.0, *WEIGHTS])}, z AS (SELECT g.family, g.w, round(g.auroc - h.auroc, 9) AS d FROM g JOIN g h ON h.family = g.family AND h.unit = g.unit AND h.w = 0),
m AS (SELECT family, w, avg(d) AS gain, avg((d >= 0)::INT) AS kept, min(d) AS worst FROM z GROUP BY 1, 2), o AS (SELECT * FROM m WHERE w = 0 OR (gain >= 0.001 AND kept >= 0.5 AND worst >= -0.2))
SELECT family, arg_max(w, (round(gain, 9), -w)) AS weight, round(arg_max(gain, (round(gain, 9), -w)), 6) AS gain FROM o GROUP BY 1"""),
    "top_terms": (top_terms, None),
    "probe_scores": (probe_scores, None),
    "routed_languages": (routed_languages, None),
    "reranked_candidates": (reranked, None),
    "ranked_candidates": (ranked_candidates, None),
    "scenario_auroc": (label_auroc, f"""
WITH {P} SELECT s.scenario, round(avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 WHEN x.score < y.score THEN 0.0 END), 6) AS auroc FROM (SELECT DISTINCT scenario FROM p) s LEFT JOIN p x ON x.scenario = s.scenario AND x.label = 1 LEFT JOIN p y ON y.scenario = s.scenario AND y.label = 0 GROUP BY 1"""),
}
