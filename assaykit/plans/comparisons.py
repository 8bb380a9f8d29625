"""Queries that compare two scorers of the same rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparisons as C
from ..operators import replay
from ..operators import resampling as S
from ..operators.metrics import auroc, binary_metrics
from ..sources.tables import predictions, read, second_predictions
from .common import B, P, rounded, with_confusion

SAMPLES = 5000
#: Both scorers side by side.
J = "j AS (SELECT p.unit, p.scenario, p.index, p.label, p.score AS x, b.score AS y, p.decision AS d, b.decision AS e FROM p JOIN b USING (index))"
_PAIRS = "pairs AS (SELECT u.unit, u.label AS l1, v.label AS l2, sign(u.x - v.x) AS sx, sign(u.y - v.y) AS sy FROM j u JOIN j v ON u.unit = v.unit AND u.index < v.index)"


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    other = second_predictions(p).select("index", F.col("score").alias("y"), F.col("decision").alias("e"))
    return p.withColumnsRenamed({"score": "x", "decision": "d"}).join(other, "index")


def _both(make):
    return lambda spark, sf: rounded(make(both(spark, sf)))


def _deltas(p: DataFrame, by: str = "unit") -> DataFrame:
    return C.unit_deltas(p, second_predictions(p), by)


def delta_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.delta_gate(_deltas(predictions(spark, sf_dir)), -0.2, -0.1))


def chosen_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten cutoffs those with a false-positive rate under 0.9; of these within 0.01 of the best balanced accuracy the highest."""
    p = predictions(spark, sf_dir).withColumn("cutoff", F.explode(F.array(*[F.lit(k) for k in range(1, 11)]))).withColumn("decision", (F.col("score") >= F.col("cutoff") / 50.0).cast("int"))
    m = binary_metrics(p, ["cutoff"]).select("cutoff", "fpr", F.round("balanced_accuracy", 6).alias("ba"))
    return rounded(C.choose_candidate(m, F.col("fpr") < 0.9, [F.desc("cutoff")], 0.01, "ba").select("cutoff", "ba"))


def transfer_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("unit", F.col("scenario"))
    halves = [_deltas(p.filter(F.pmod("index", F.lit(2)) == k)) for k in (0, 1)]
    return rounded(C.transfer_stability(*halves))


def admit_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("source", F.concat_ws("|", "unit", "scenario"))
    sources = _deltas(p, "source").withColumn("unit", F.substring_index("source", "|", 1))
    return rounded(C.admit_categories(_deltas(p), sources, "unit", 0.02, -0.5))


def repeat_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a part as annotations of its suppliers; N is neutral."""
    return C.repeat_consistency(read(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_suppkey"], "l_orderkey", "l_returnflag", "N")


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.content_fingerprint(read(spark, sf_dir, "documents"), "doc_id", ["text", "lang"])


def digit(text):
    return text.rlike("[0-9]").cast("int")


def bootstrap_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).withColumn("unit", F.col("scenario"))
    return rounded(S.bootstrap_units(_deltas(p), "unit", SAMPLES))


def replayed_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as the outputs of three members of a row; any digit from 1 to 7 is a rating."""
    p = predictions(spark, sf_dir).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), "text"), "index")
    rows = p.select("unit", "scenario", F.floor(F.col("index") / 3).alias("index"), F.pmod("index", F.lit(3)).alias("member"), "label", "text")
    return rounded(replay.replay_cuts(rows, "[1-7]", [200, 800, 3000], ". ", 5))


def bootstrap_auroc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change of AUROC of the scenarios, resampled over scenarios."""
    rows = both(spark, sf_dir)
    side = lambda c: auroc(rows.select(F.col("scenario").alias("unit"), "label", F.col(c).alias("score")), ["unit"]).withColumnRenamed("auroc", c)
    return rounded(S.bootstrap_units(side("x").join(side("y"), "unit").withColumn("delta", F.col("y") - F.col("x")), "unit", SAMPLES))


def _ba(table: str, by: str, name: str, where: str = "TRUE") -> str:
    return f"{name} AS ({with_confusion(f'(SELECT * FROM {table} WHERE {where})', by)})"


def _fraction(seed: str, *columns: str) -> str:
    return f"('0x' || sha256('{seed}' || " + " || ".join(f"chr(31) || {c}" for c in columns) + ")[1:13])::BIGINT::DOUBLE / 4503599627370496.0"


def _binomial(name: str, rows: str, n: str, a: str, b: str, u: str, out: str) -> str:
    """``rows`` with a draw of Binomial(n, a / b) at u, by its distribution function for each distinct (n, a, b)."""
    log = "lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(a / b::DOUBLE) + (n - j) * ln(1 - a / b::DOUBLE)"
    return f"""{name}_k AS (SELECT DISTINCT {n} AS n, {a} AS a, {b} AS b FROM {rows}),
{name}_j AS (SELECT n, a, b, unnest(range(0, n)) AS j FROM {name}_k WHERE a > 0 AND a < b),
{name}_t AS (SELECT n, a, b, list(f ORDER BY j) AS f FROM (SELECT n, a, b, j, sum(exp({log})) OVER (PARTITION BY n, a, b ORDER BY j) AS f FROM {name}_j) GROUP BY 1, 2, 3),
{name} AS (SELECT r.*, CASE WHEN {a} = 0 OR {n} = 0 THEN 0 WHEN {a} = {b} THEN {n} ELSE len(list_filter(t.f, lambda x: x <= {u})) END AS {out} FROM {rows} r LEFT JOIN {name}_t t ON t.n = {n} AND t.a = {a} AND t.b = {b})"""


def _mix32(x: str) -> str:
    step = lambda x, by, times: f"list_transform([{x}], lambda z: (xor(z, z >> {by}) * {times}::UBIGINT) % 4294967296)[1]"
    return f"list_transform([{step(step(x, 16, 0x7FEB352D), 15, 0x846CA68B)}], lambda z: xor(z, z >> 16))[1]"


_INTERVAL = "count(*) AS samples, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, round(avg((delta > 0)::INT), 6) AS above"
_MACRO = f"every AS (SELECT unit, delta FROM deltas UNION ALL SELECT NULL, avg(delta) FROM deltas GROUP BY sample) SELECT unit, {_INTERVAL} FROM every WHERE delta IS NOT NULL GROUP BY unit"
_UNIT_DRAWS = f"""k AS (SELECT count(*) AS n FROM d), s AS (SELECT sample, unnest(range(1, n + 1)) AS draw, n FROM k, (SELECT unnest(range(1, {SAMPLES} + 1)) AS sample)),
x AS (SELECT sample, floor({_fraction("units", "sample", "draw")} * n) + 1 AS i FROM s), deltas AS (SELECT sample, avg(delta) AS delta FROM x JOIN d USING (i) GROUP BY sample)
SELECT {_INTERVAL} FROM deltas"""
_CREDIT = """
credit AS (SELECT u.unit, u.index, u.label, avg(CASE WHEN (u.{s} - v.{s}) * (2 * u.label - 1) > 0 THEN 1.0 WHEN u.{s} = v.{s} THEN 0.5 ELSE 0.0 END) AS c
           FROM j u JOIN j v ON u.unit = v.unit AND u.label <> v.label GROUP BY 1, 2, 3)
"""

_CUT_MEASURES = """count(*) AS rows, (count(*) FILTER (d AND label = 1) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE + 1 - count(*) FILTER (d AND label = 0) / nullif(count(*) FILTER (label = 0), 0)::DOUBLE) / 2 AS ba,
avg((d = e)::INT) AS agreement, sum(kept) / nullif(sum(n), 0)::DOUBLE AS chars, sum(unrated)::BIGINT AS unrated"""

QUERIES = {
    "delta_gate": (delta_gate, f"""
WITH {P}, {B}, {_ba("p", "unit", "m")}, {_ba("b", "unit", "n")}, d AS (SELECT n.ba - m.ba AS delta FROM m JOIN n USING (unit))
SELECT count(delta) AS units, round(min(delta), 6) AS worst, round(avg(delta), 6) AS mean, coalesce(min(delta) >= -0.2 AND avg(delta) >= -0.1, FALSE) AS passed FROM d"""),
    "chosen_cutoff": (chosen_cutoff, f"""
WITH {P}, c AS (SELECT p.* EXCLUDE (decision), cutoff, (score >= cutoff / 50.0::DOUBLE)::INT AS decision FROM p, (SELECT unnest(range(1, 11))::INT AS cutoff)),
f AS (SELECT cutoff, count(*) FILTER (label = 0 AND decision = 1) / count(*) FILTER (label = 0)::DOUBLE AS fpr FROM c GROUP BY 1),
m AS (SELECT cutoff, round(ba, 6) AS ba FROM ({with_confusion("c", "cutoff")}) JOIN f USING (cutoff) WHERE fpr < 0.9)
SELECT cutoff, ba FROM m WHERE ba >= (SELECT max(ba) FROM m) - 0.01 ORDER BY cutoff DESC LIMIT 1"""),
    "transfer_stability": (transfer_stability, f"""
WITH {P.replace("d.lang AS unit", "d.source AS unit")}, {B}, {_ba("p", "unit", "m0", "index % 2 = 0")}, {_ba("b", "unit", "n0", "index % 2 = 0")}, {_ba("p", "unit", "m1", "index % 2 = 1")}, {_ba("b", "unit", "n1", "index % 2 = 1")},
d AS (SELECT n0.ba - m0.ba AS x, n1.ba - m1.ba AS y FROM m0 JOIN n0 USING (unit) JOIN m1 USING (unit) JOIN n1 USING (unit) WHERE n0.ba - m0.ba IS NOT NULL AND n1.ba - m1.ba IS NOT NULL)
SELECT count(*) AS units, round(avg((sign(x) = sign(y))::INT), 6) AS same_sign, round(avg((x * y >= 0)::INT), 6) AS not_opposed, count(*) FILTER (x > 0 AND y > 0) AS wins,
       count(*) FILTER (x < 0 AND y < 0) AS losses, count(*) FILTER (x * y < 0) AS reversals, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END, 6) AS pearson FROM d"""),
    "order_agreement": (_both(lambda j: C.order_agreement(j, ["unit"], "x", "y")), f"""
WITH {P}, {B}, {J}, {_PAIRS}, s AS (SELECT unit, count(*) AS pairs, avg((sx = sy)::INT) AS agreement, count(*) FILTER (l1 <> l2) AS cross_pairs, avg((sx = sy)::INT) FILTER (l1 <> l2) AS cross_agreement,
avg((sx = 0 OR sy = 0)::INT) AS tie_rate, sum(sx * sy) / sqrt(nullif(sum(abs(sx)) * sum(abs(sy)), 0)) AS tau FROM pairs GROUP BY unit)
SELECT unit, pairs, round(agreement, 6) AS agreement, cross_pairs, round(cross_agreement, 6) AS cross_agreement, round(tie_rate, 6) AS tie_rate, round(tau, 6) AS tau FROM s"""),
    "pair_complementarity": (_both(lambda j: C.pair_complementarity(j, ["unit"], "x", "y")), f"""
WITH {P}, {B}, {J}, q AS (SELECT u.unit, u.x > v.x AS a, u.y > v.y AS b FROM j u JOIN j v ON u.unit = v.unit AND u.label = 1 AND v.label = 0)
SELECT unit, count(*) AS pairs, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND b) AS recovered, count(*) FILTER (a AND NOT b) AS harmed, count(*) FILTER (NOT a AND NOT b) AS neither FROM q GROUP BY unit
UNION ALL SELECT unit, 0, 0, 0, 0, 0 FROM j GROUP BY unit HAVING min(label) = max(label)"""),
    "auroc_attribution": (_both(lambda j: C.auroc_attribution(j, "unit", "index", "x", "y")), f"""
WITH {P}, {B}, {J}, a AS (WITH {_CREDIT.format(s="x")} SELECT * FROM credit), z AS (WITH {_CREDIT.format(s="y")} SELECT * FROM credit), n AS (SELECT unit, label, count(*) AS n FROM j GROUP BY 1, 2)
SELECT j.unit, j.index, round(z.c - a.c, 6) AS change, round((z.c - a.c) / (2 * n), 6) AS part FROM j LEFT JOIN a USING (index) LEFT JOIN z USING (index) JOIN n ON n.unit = j.unit AND n.label = j.label"""),
    "content_fingerprint": (fingerprint, """
WITH r AS (SELECT sha256(doc_id::VARCHAR) AS k, sha256(doc_id || chr(31) || coalesce(text, chr(0)) || chr(31) || coalesce(lang, chr(0))) AS h FROM documents),
b AS (SELECT k[1:2] AS bucket, sha256(string_agg(k || h, '' ORDER BY k || h)) AS d, count(*) AS n FROM r GROUP BY 1)
SELECT sum(n)::BIGINT AS rows, sha256(string_agg(bucket || d, '' ORDER BY bucket || d)) AS digest FROM b"""),
    "order_changes": (_both(lambda j: C.order_changes(j, "unit", "index", "x", "y")), f"""
WITH {P}, {B}, {J}, r AS (SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY x DESC, index) AS m, row_number() OVER (PARTITION BY unit ORDER BY y DESC, index) AS n FROM j)
SELECT unit, count(*) AS rows, count(*) FILTER (m <> n) AS moved FROM r GROUP BY unit"""),
    "prefix_replay": (lambda s, d: rounded(C.prefix_replay(read(s, d, "documents"), "text", [200, 500, 2000], digit)), """
WITH r AS (SELECT cap, regexp_matches(text, '[0-9]') AS a, regexp_matches(substr(text, 1, cap), '[0-9]') AS b, length(text) AS n, greatest(0, length(text) - cap) AS saved
           FROM documents, (SELECT unnest([200, 500, 2000]) AS cap) WHERE text IS NOT NULL)
SELECT cap, count(*) AS rows, count(*) FILTER (a = b) AS kept, round(sum(saved) / sum(n)::DOUBLE, 6) AS saved FROM r GROUP BY cap"""),
    "replayed_cuts": (replayed_cuts, rf"""
WITH {P}, o AS (SELECT p.unit, p.scenario, p.index // 3 AS index, p.label, coalesce(d.text, '') AS t FROM p JOIN documents d ON d.doc_id = p.index),
m AS (SELECT *, regexp_extract_all(t, '[1-7]') AS f, string_split_regex(t, '[1-7]') AS b, length(t) AS n, instr(t, '. ') - 1 AS mk FROM o),
s AS (SELECT *, list_transform(range(1, len(f) + 1), lambda i: {{'u': list_sum(list_transform(b[1:i], lambda x: length(x)))::INT + i::INT, 'v': f[i]::INT}}) AS st FROM m),
z AS (SELECT *, list_transform(st, lambda r: {{'u': r.u, 'v': r.v, 'k': NOT regexp_matches(substr(t, r.u + 1, 1), '^\w')}}) AS rs FROM s),
c AS (SELECT *, unnest([{{'cut': 'full', 'u': n}}, {{'cut': 'cap 200', 'u': least(n, 200)}}, {{'cut': 'cap 800', 'u': least(n, 800)}}, {{'cut': 'cap 3000', 'u': least(n, 3000)}}, {{'cut': 'marker', 'u': CASE WHEN mk >= 0 THEN mk ELSE n END}}, {{'cut': 'first rating', 'u': coalesce(list_filter(rs, lambda r: r.k)[1].u, n)}}]) AS c FROM z),
r AS (SELECT unit, scenario, index, label, n, c.cut AS cut, c.u AS u, coalesce(list_filter(rs, lambda r: (r.u < c.u AND r.k) OR r.u = c.u)[-1].v, 0) AS r, coalesce(list_filter(rs, lambda r: (r.u < n AND r.k) OR r.u = n)[-1].v, 0) AS f FROM c),
a AS (SELECT cut, unit, scenario, index, label, max(r) >= 5 AS d, max(f) >= 5 AS e, sum(u) AS kept, sum(n) AS n, count(*) FILTER (r = 0) AS unrated FROM r GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT cut, unit, scenario, {_CUT_MEASURES} FROM a GROUP BY GROUPING SETS ((cut), (cut, unit), (cut, scenario)))
SELECT cut, CASE WHEN scenario IS NULL THEN 'all' ELSE scenario END AS scope, rows, round(ba, 6) AS balanced_accuracy, round(agreement, 6) AS agreement, round(chars, 6) AS chars, unrated FROM x WHERE unit IS NULL
UNION ALL SELECT cut, 'macro', rows, round((SELECT avg(ba) FROM x y WHERE y.cut = x.cut AND y.unit IS NOT NULL), 6), round(agreement, 6), round(chars, 6), unrated FROM x WHERE unit IS NULL AND scenario IS NULL"""),
    "bootstrap_ba": (_both(lambda j: S.bootstrap_ba(j, "unit", SAMPLES, a="d", b="e")), f"""
WITH {P}, {B}, {J}, c AS (SELECT unit, label AS l, count(*) AS n, count(*) FILTER (e > d) AS up, count(*) FILTER (e < d) AS down FROM j GROUP BY 1, 2),
s AS (SELECT c.*, up + down AS moving, sample, {_fraction("bau", "sample", "unit", "l")} AS u, {_fraction("bav", "sample", "unit", "l")} AS v FROM c, (SELECT unnest(range(1, {SAMPLES + 1})) AS sample)),
{_binomial("m1", "s", "r.n", "r.moving", "r.n", "r.u", "moved").replace("DISTINCT r.n AS n, r.moving AS a, r.n AS b FROM s", "DISTINCT n, moving AS a, n AS b FROM s")},
{_binomial("m2", "m1", "r.moved", "r.up", "r.moving", "r.v", "raised").replace("DISTINCT r.moved AS n, r.up AS a, r.moving AS b FROM m1", "DISTINCT moved AS n, up AS a, moving AS b FROM m1")},
deltas AS (SELECT unit, sample, (sum((2 * raised - moved) / n::DOUBLE) FILTER (l = 1) - sum((2 * raised - moved) / n::DOUBLE) FILTER (l = 0)) / 2 AS delta FROM m2 GROUP BY 1, 2), {_MACRO}"""),
    "bootstrap_auroc": (_both(lambda j: S.bootstrap_auroc(j, "unit", "index", "x", "y", SAMPLES)), f"""
WITH {P}, {B}, {J}, o AS (SELECT unit, label, x, y, row_number() OVER (PARTITION BY unit, label ORDER BY x, y) - 1 AS i FROM j),
c AS (SELECT unit, label, count(*) AS n, {_mix32("xor(('0x' || sha256('auroc' || unit)[1:8])::UBIGINT, CASE label WHEN 1 THEN 0 ELSE 2654435769 END::UBIGINT)")} AS h FROM o GROUP BY unit, label),
s AS (SELECT unit, label, n, sample, {_mix32("(h + sample::UBIGINT) % 4294967296")} AS h FROM c, (SELECT unnest(range(1, {SAMPLES + 1})) AS sample)),
d AS (SELECT unit, label, sample, n, h, unnest(range(0, n)) AS k FROM s),
w AS (SELECT unit, label, sample, ({_mix32("(h + k::UBIGINT) % 4294967296")} * n::UBIGINT) >> 32 AS i, count(*) AS w FROM d GROUP BY ALL),
r AS (SELECT w.unit, w.label, sample, w, x, y FROM w JOIN o ON o.unit = w.unit AND o.label = w.label AND o.i = w.i::BIGINT),
q AS (SELECT u.unit, u.sample, sum(u.w * v.w * CASE WHEN u.x > v.x THEN 1.0 WHEN u.x = v.x THEN 0.5 ELSE 0 END) / sum(u.w * v.w) AS a, sum(u.w * v.w * CASE WHEN u.y > v.y THEN 1.0 WHEN u.y = v.y THEN 0.5 ELSE 0 END) / sum(u.w * v.w) AS b
      FROM r u JOIN r v ON u.unit = v.unit AND u.sample = v.sample AND u.label = 1 AND v.label = 0 GROUP BY 1, 2),
deltas AS (SELECT unit, sample, b - a AS delta FROM q), {_MACRO}"""),
    "bootstrap_auroc_units": (bootstrap_auroc_units, f"""
WITH {P}, {B}, {J}, a AS (SELECT u.scenario AS unit, avg(CASE WHEN u.y > v.y THEN 1.0 WHEN u.y = v.y THEN 0.5 ELSE 0.0 END) - avg(CASE WHEN u.x > v.x THEN 1.0 WHEN u.x = v.x THEN 0.5 ELSE 0.0 END) AS delta FROM j u JOIN j v ON u.scenario = v.scenario AND u.label = 1 AND v.label = 0 GROUP BY 1),
d AS (SELECT row_number() OVER (ORDER BY unit) AS i, delta FROM a), {_UNIT_DRAWS}"""),
    "bootstrap_units": (bootstrap_units, f"""
WITH {P.replace("d.lang AS unit", "d.source AS unit")}, {B}, {_ba("p", "unit", "m")}, {_ba("b", "unit", "n")}, d AS (SELECT row_number() OVER (ORDER BY unit) AS i, n.ba - m.ba AS delta FROM m JOIN n USING (unit) WHERE n.ba - m.ba IS NOT NULL),
{_UNIT_DRAWS}"""),
    "admit_categories": (admit_categories, f"""
WITH {P.replace("d.lang AS unit,", "d.lang AS unit, d.lang || '|' || d.source AS source,")}, b AS (SELECT * EXCLUDE (score, decision), (index % 97 >= 40)::INT AS decision FROM p), {_ba("p", "unit", "m")}, {_ba("b", "unit", "n")}, {_ba("p", "source", "ms")}, {_ba("b", "source", "ns")},
w AS (SELECT split_part(source, '|', 1) AS unit, min(ns.ba - ms.ba) AS worst FROM ms JOIN ns USING (source) GROUP BY 1)
SELECT m.unit, round(n.ba - m.ba, 6) AS delta, round(worst, 6) AS worst_source, CASE WHEN n.ba - m.ba >= 0.02 AND coalesce(worst, 0) >= -0.5 THEN 'semantic' WHEN n.ba - m.ba >= 0 THEN 'ordinary' ELSE 'none' END AS admit
FROM m JOIN n USING (unit) LEFT JOIN w ON w.unit = m.unit"""),
    "repeat_consistency": (repeat_consistency, """
WITH o AS (SELECT l_partkey, l_suppkey, l_orderkey, min(l_returnflag) AS label FROM lineitem GROUP BY 1, 2, 3),
q AS (SELECT a.l_partkey, a.label AS x, b.label AS y FROM o a JOIN o b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey)
SELECT l_partkey, count(*) AS pairs, count(*) FILTER (x = y) AS equal, count(*) FILTER ((x = 'N') = (y = 'N')) AS alike, count(*) FILTER (x <> 'N' AND y <> 'N' AND x <> y) AS conflicts FROM q GROUP BY 1"""),
}
