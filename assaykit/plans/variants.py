"""Queries of hard negatives, evidence variants, synthetic candidates and parameter choices under floors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import knowledge as K
from ..operators import learning as L
from ..operators import records
from ..operators import relations as R
from ..sources.tables import predictions, read
from . import knowledge, learning, parsing, relations
from .common import B, P, rounded

KINDS = ["A", "N"]
WEIGHTS, FLOOR = learning.WEIGHTS, -0.02


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as candidates: decisive where returned, chosen where their quantity is large."""
    li = read(spark, sf_dir, "lineitem")
    topical = (F.pmod("l_partkey", F.lit(3)) == 0).cast("int")
    text = F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("kind"), (F.col("l_returnflag") == "R").cast("int").alias("decisive"), (F.col("l_quantity") >= 30).cast("int").alias("chosen"), topical.alias("topical"), text.alias("text"))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.hard_negatives(_lines(spark, sf_dir), "l_orderkey", "l_linenumber", "decisive", "chosen", "kind", "l_partkey", 3, KINDS)


def picked_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by the utility of lines, topical ones first among the rejected."""
    gains = relations._probabilities(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("gain", 6).alias("gain"))
    lines = _lines(spark, sf_dir)
    rows = gains.join(lines, ["l_orderkey", "l_linenumber"]).withColumn("size", F.length("text"))
    picks = E.pick_candidate(rows, "l_orderkey", "gain", "decisive", "size", "l_linenumber", 0.2, "topical")
    return records.picked_variants(picks, lines, "l_orderkey", "l_linenumber", "text")


def mixed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "text")
    out = records.mixed_variants(p.select("index").join(docs, "index"), "index", "text", R.assign_donors(p, "unit", "index"))
    return out.select("index", "variant", F.md5("evidence").alias("digest"), "origin")


def balanced_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("wrong", (F.col("decision") != F.col("label")).cast("int"))
    return E.balanced_contradictions(p, "index", "wrong")


def synthetic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.synthetic_candidates(knowledge._facts(spark, sf_dir).withColumnRenamed("object", "value"))


def floored_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learning.both(spark, sf_dir).withColumn("family", F.pmod("index", F.lit(3)))
    return rounded(L.select_parameters(rows, "family", "unit", "x", "y", WEIGHTS, 0.001, 0.5, -0.2, "scenario", FLOOR))


def ordered_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = L.metric_grid(learning.both(spark, sf_dir), ["scenario"], "x", "y", WEIGHTS)
    return rounded(L.grid_select(grid, L.best_first("weight"), ["scenario"]))


_LINES = "li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS kind, (l_quantity >= 30)::INT AS chosen, (l_partkey % 3 = 0)::INT AS topical, concat_ws(' ', l_returnflag, l_linestatus, l_partkey::VARCHAR) AS text FROM lineitem)"
_KEY = "'negatives' || chr(31) || entity || chr(31) || predicate"
_ASKED = "c.entity, c.predicate, {rank} AS rank, o, '{kind}' AS kind, b.entity AS c_entity, b.predicate AS c_predicate, b.value AS c_value"


def _next(rank: int, kind: str, on: str) -> str:
    return f"SELECT {_ASKED.format(rank=rank, kind=kind)} FROM r c, s JOIN r b ON {on}"


def _second(sql: str) -> str:
    """The grid of scenarios beside that of units."""
    return sql.replace("k AS (", "k2 AS (", 1).replace("\ng AS (", "\ng2 AS (", 1).replace("FROM k u JOIN k v", "FROM k2 u JOIN k2 v")


QUERIES = {
    "hard_negatives": (hard_negatives, f"""
WITH {_LINES}, r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY chosen DESC, CASE kind WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_partkey DESC, l_linenumber)::INT AS place FROM li WHERE kind <> 'R')
SELECT l_orderkey, place, l_linenumber FROM r WHERE place <= 3"""),
    "picked_variants": (picked_variants, f"""
WITH {relations._PROB}, {_LINES}, h AS (SELECT l_orderkey, l_linenumber AS c, round(gain, 6) AS gain, kind, topical, length(text) AS size FROM g JOIN li USING (l_orderkey, l_linenumber)),
k AS (SELECT l_orderkey, arg_min(c, (gain, c)) FILTER (gain < -0.2 AND kind <> 'R') AS harmful, arg_min(c, (-gain, c)) FILTER (gain > 0.2) AS helpful, arg_min(c, (1 - topical, size, c)) FILTER (abs(gain) <= 0.2) AS insufficient FROM h GROUP BY 1),
q AS (SELECT l_orderkey, 'harmful' AS variant, harmful AS origin FROM k UNION ALL SELECT l_orderkey, 'helpful', helpful FROM k UNION ALL SELECT l_orderkey, 'insufficient', insufficient FROM k)
SELECT l_orderkey, variant, text AS evidence, origin FROM q JOIN li USING (l_orderkey) WHERE li.l_linenumber = origin"""),
    "mixed_variants": (mixed_variants, f"""
WITH v AS ({parsing.QUERIES["expanded_variants"][1]})
SELECT index, 'mixed' AS variant, md5(coalesce(a.text, '') || chr(10) || coalesce(b.text, '')) AS digest, origin FROM v JOIN documents a ON a.doc_id = index JOIN documents b ON b.doc_id = origin WHERE variant = 'shuffled'"""),
    "balanced_contradictions": (balanced_contradictions, f"""
WITH {P}, w AS (SELECT index, label, row_number() OVER (PARTITION BY label ORDER BY sha256('contradiction' || chr(31) || index), index) AS i FROM p WHERE decision <> label),
n AS (SELECT least(count(*) FILTER (label = 0), count(*) FILTER (label = 1)) AS n FROM w)
SELECT index, CASE WHEN label = 0 THEN 'ordinary_error' ELSE 'deception' END AS variant FROM w, n WHERE i <= n"""),
    "synthetic_candidates": (synthetic_candidates, f"""
WITH {knowledge._FACTS}, pool AS (SELECT entity, predicate, arg_min(object, (sha256({_KEY} || chr(31) || object), object)) AS value FROM f GROUP BY 1, 2),
d AS (SELECT *, sha256({_KEY}) AS d, entity || chr(31) || predicate AS k FROM pool),
r AS (SELECT entity, predicate, value, row_number() OVER (PARTITION BY predicate ORDER BY d, k) - 1 AS i, count(*) OVER (PARTITION BY predicate) AS n, row_number() OVER (ORDER BY d, k) - 1 AS g, count(*) OVER () AS t,
row_number() OVER (PARTITION BY entity ORDER BY predicate) - 1 AS e, count(*) OVER (PARTITION BY entity) AS m FROM d), s AS (SELECT unnest(range(1, 9)) AS o),
c AS (SELECT entity, predicate, 0 AS rank, 0 AS o, 'anchor' AS kind, entity AS c_entity, predicate AS c_predicate, value AS c_value FROM r
UNION ALL {_next(1, "relevant_insufficient", "b.entity = c.entity AND o <= 2 AND o < c.m AND b.e = (c.e + o) % c.m")}
UNION ALL {_next(2, "irrelevant", "b.predicate = c.predicate AND o <= 2 AND o < c.n AND b.i = (c.i + o) % c.n")}
UNION ALL {_next(3, "irrelevant", "o < c.t AND b.g = (c.g + o) % c.t AND b.entity <> c.entity AND b.predicate <> c.predicate")}),
w AS (SELECT *, (row_number() OVER (PARTITION BY entity, predicate ORDER BY rank, o) - 1)::INT AS place FROM c)
SELECT entity, predicate, place, kind, c_entity, c_predicate, c_value FROM w WHERE place < 8"""),
    "floored_parameters": (floored_parameters, f"""
WITH {P}, {B}, {learning.J}, {learning._grid("family, unit", [0.0, *WEIGHTS])}, {_second(learning._grid("family, scenario", [0.0, *WEIGHTS]))},
z AS (SELECT g.family, g.w, round(g.auroc - h.auroc, 9) AS d FROM g JOIN g h ON h.family = g.family AND h.unit = g.unit AND h.w = 0),
y AS (SELECT g2.family, g2.w, min(round(g2.auroc - h.auroc, 9)) AS least FROM g2 JOIN g2 h ON h.family = g2.family AND h.scenario = g2.scenario AND h.w = 0 GROUP BY 1, 2),
m AS (SELECT family, w, avg(d) AS gain, avg((d >= 0)::INT) AS kept, min(d) AS worst FROM z GROUP BY 1, 2), o AS (SELECT m.* FROM m LEFT JOIN y USING (family, w) WHERE w = 0 OR (gain >= 0.001 AND kept >= 0.5 AND worst >= -0.2 AND coalesce(least >= {FLOOR}, true)))
SELECT family, arg_max(w, (round(gain, 9), -w)) AS weight, round(arg_max(gain, (round(gain, 9), -w)), 6) AS gain FROM o GROUP BY 1"""),
    "ordered_choice": (ordered_choice, f"""
WITH {P}, {B}, {learning.J}, {learning._grid("scenario", WEIGHTS)}, a AS (SELECT scenario, w, count(*) FILTER (label = 1 AND s >= 0.5) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE AS tpr, count(*) FILTER (label = 0 AND s >= 0.5) / nullif(count(*) FILTER (label = 0), 0)::DOUBLE AS fpr FROM k GROUP BY 1, 2),
r AS (SELECT scenario, w, (tpr + 1 - fpr) / 2 AS ba, auroc, fpr, row_number() OVER (PARTITION BY scenario ORDER BY round((tpr + 1 - fpr) / 2, 9) DESC NULLS LAST, round(auroc, 9) DESC NULLS LAST, round(fpr, 9) NULLS LAST, w) AS i FROM a LEFT JOIN g USING (scenario, w))
SELECT scenario, w AS weight, round(ba, 6) AS balanced_accuracy, round(auroc, 6) AS auroc, round(fpr, 6) AS fpr FROM r WHERE i = 1"""),
}
