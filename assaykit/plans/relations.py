"""Queries of aligned labels, facts, entities, donors, evidence, orders and batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from ..operators import batches as batching
from ..operators import donors as donation
from ..operators import evidence as E
from ..operators import metrics
from ..operators import intervals
from ..operators import relations as R
from ..operators.ranks import value_places
from ..sources.tables import predictions, read
from .common import P, rounded, with_confusion


def _mod(column: str, n: int):
    return F.pmod(F.col(column), F.lit(n))


def aligned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined strictly to a prediction for each, scored as one unit."""
    p = predictions(spark, sf_dir)
    both = R.align(p.select("index", "score", "decision"), p.select("index", "label")).withColumn("unit", F.lit("all"))
    return rounded(metrics.score_units(both))


def aligned_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    both = R.align(p.filter(_mod("index", 3) == 0).select("index", "decision"), p.select("unit", "index", "label"), partial=True)
    return rounded(metrics.binary_metrics(both, ["unit"]).select("unit", "recall", "fpr"))


def manifest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    manifest = labels.withColumn("quality", F.when(_mod("doc_id", 7) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return R.manifest_report(labels.filter(_mod("doc_id", 5) != 0), manifest, "doc_id", "quality")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facts of their nation, some open at an end."""
    c = read(spark, sf_dir, "customer")
    start = F.lit(1990) + _mod("c_custkey", 9)
    return c.select("c_nationkey", "c_custkey", F.when(_mod("c_custkey", 7) != 0, start).alias("start"), F.when(_mod("c_custkey", 5) != 0, start + _mod("c_custkey", 4)).alias("end"))


def facts_for_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", F.when(_mod("o_orderkey", 11) != 0, F.year("o_orderdate")).alias("year")).distinct()
    return intervals.facts_for_claims(claims, _terms(spark, sf_dir), ["c_nationkey"], slack=1).groupBy("c_nationkey", "year").agg(F.count(F.lit(1)).alias("facts"))


def overlapping_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    start = F.lit(1990) + _mod("s_suppkey", 17)
    facts = s.select(F.col("s_suppkey").alias("person"), F.col("s_nationkey").alias("office"), _mod("s_nationkey", 5).alias("jurisdiction"), start.alias("start"), F.when(_mod("s_suppkey", 11) != 0, start + _mod("s_suppkey", 3)).alias("end"))
    return intervals.overlapping_holders(facts)


def concurrent_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers hold offices of their nation from a month on; ministers beside kings."""
    c = read(spark, sf_dir, "customer")
    year = (F.lit(1900) + _mod("c_custkey", 83)).cast("string")
    start = F.when(_mod("c_custkey", 3) == 0, year).otherwise(F.concat(year, F.lit("-0"), (_mod("c_custkey", 9) + 1).cast("string")))
    end = F.when(_mod("c_custkey", 13) != 0, (F.lit(1900) + _mod("c_custkey", 83) + _mod("c_custkey", 5)).cast("string"))
    role = F.when(_mod("c_custkey", 2) == 0, "King of it").otherwise("Prime Minister")
    facts = c.select(F.col("c_custkey").alias("person"), _mod("c_custkey", 4).alias("office"), F.col("c_nationkey").alias("jurisdiction"), role.alias("role"), intervals.months(start).alias("start"), intervals.months(end, True).alias("end"))
    return intervals.concurrent_holders(facts, "prime minister|premier", "monarch|king").select("person", "other")


def relation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders claim the nation of their customer; half of the customers are known from their own side, others from the nation's."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("c"), F.concat(F.lit("n"), "c_nationkey").alias("n"), "c_custkey")
    facts = c.filter(_mod("c_custkey", 2) == 0).select(F.col("c").alias("subject"), F.lit("nation").alias("predicate"), F.col("n").alias("object"))
    facts = facts.unionByName(c.filter(_mod("c_custkey", 3) == 0).select(F.col("n").alias("subject"), F.lit("home_of").alias("predicate"), F.col("c").alias("object")))
    claims = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), F.concat(F.lit("c"), "o_custkey").alias("subject"), F.lit("nation").alias("predicate"), F.concat(F.lit("n"), _mod("o_custkey", 25)).alias("object"))
    return R.relation_evidence(claims, facts, ["nation"], {"home_of": "nation"}).groupBy("status").agg(F.count(F.lit(1)).alias("claims"))


def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as mentions of benchmark items by their first lines."""
    head = lambda t: F.substring_index(t, "\n", 1)
    claims = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim"), head(F.col("text")).alias("mention"))
    entities = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity"), head(F.col("text")).alias("name"))
    mixed = claims.unionByName(entities.select((-F.col("entity") - 1).alias("claim"), F.col("name").alias("mention")))
    return R.link_entities(mixed, entities)


def linked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by their first or last line, told apart by the language and text of the document that mentions them."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    claims = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("claim"), F.substring_index("text", "\n", 1).alias("mention"), F.col("text").alias("question"), F.col("lang").alias("values"))
    names = F.explode(F.array(F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1)))
    entities = items.select(F.col("item_id").alias("entity"), names.alias("name"), F.col("text").alias("about"))
    mixed = claims.unionByName(items.select((-F.col("item_id") - 1).alias("claim"), F.substring_index("text", "\n", -1).alias("mention"), F.col("text").alias("question"), F.lit("en").alias("values")))
    return R.link_entities(mixed, entities, hints=[("[0-9]", ["th", "en"])])


def donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.assign_donors(predictions(spark, sf_dir), "unit", "index")


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").filter("text IS NOT NULL")
    out = R.compose(docs.select("doc_id", "quality", F.col("text").alias("prompt")), docs.select("doc_id", "quality", F.lit("-").alias("prompt"), "lang"), "doc_id", "quality", "prompt")
    return out.select("doc_id", "quality", "lang", F.md5("prompt").alias("digest"))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers point to the half of their number; every seventh is a page, and two of them point at each other."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    target = F.when(F.col("k") == 3, 6).when(F.col("k") == 6, 3).otherwise(F.floor(F.col("k") / 2))
    return R.resolve_redirects(c.filter("k % 7 <> 0").select(F.col("k").alias("name"), target.cast("long").alias("target")), c.filter("k % 7 = 0").select(F.col("k").alias("name"), (F.col("k") * 10).alias("page")))


def masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as candidates of a claim, their masses from discount and tax."""
    li = read(spark, sf_dir, "lineitem")
    one = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_discount").alias("d"), F.min("l_tax").alias("t"), F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("flag"))
    s, c = F.round(F.col("d") * 6, 4), F.round(F.col("t") * 8, 4)
    return one.select("l_orderkey", "l_linenumber", "q", "flag", s.alias("support"), c.alias("contradict"), F.round(F.greatest(F.lit(0.0), 1 - s - c), 4).alias("neutral"))


_ONE = "one AS (SELECT l_orderkey, l_linenumber, min(l_discount) AS d, min(l_tax) AS t, min(l_quantity) AS q, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2)"
_MASS = f"{_ONE}, m AS (SELECT l_orderkey, l_linenumber, q, flag, round(d * 6, 4) AS support, round(t * 8, 4) AS contradict, round(greatest(0.0, 1 - round(d * 6, 4) - round(t * 8, 4)), 4) AS neutral FROM one)"


def _verdicts(table: str, name: str) -> str:
    return f"""{name}k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY support + contradict DESC, l_linenumber) AS r FROM {table}),
{name}g AS (SELECT l_orderkey, count(*) AS kept, max(support) AS support, max(contradict) AS contradict, min(neutral) AS neutral FROM {name}k WHERE r <= 3 GROUP BY 1),
{name} AS (SELECT l_orderkey, kept, support, contradict, CASE WHEN greatest(support, contradict) < 0.3 OR neutral > greatest(support, contradict) THEN 'NOT_ENOUGH_INFO' WHEN support >= contradict THEN 'SUPPORTS' ELSE 'REFUTES' END AS verdict, greatest(support, contradict) AS confidence FROM {name}g)"""


def evidence(df: DataFrame) -> DataFrame:
    return E.aggregate_evidence(df, "l_orderkey", "l_linenumber", 3, 0.3)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "SUPPORTS").otherwise("REFUTES").alias("truth"))


_TRUTH = "t AS (SELECT o_orderkey AS l_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'SUPPORTS' ELSE 'REFUTES' END AS truth FROM orders)"


def decision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.verdict_report(evidence(masses(spark, sf_dir)).join(_truth(spark, sf_dir), "l_orderkey"), "o_orderpriority", "verdict", "truth"))


def paired_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the evidence of the order whose number lies 7 lower."""
    m = masses(spark, sf_dir)
    real, shuffled = evidence(m), evidence(m.withColumn("l_orderkey", F.col("l_orderkey") + 7))
    return E.paired_verdicts(real.join(_truth(spark, sf_dir), "l_orderkey"), shuffled.join(_truth(spark, sf_dir), "l_orderkey"), "l_orderkey", "truth")


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masses(spark, sf_dir)
    return E.utility(m.select("l_orderkey", "l_linenumber", "flag", (F.col("q") / 52).alias("real"), (F.lit(0.3) + _mod("l_orderkey", 5) * 0.1).alias("empty"), (F.lit(0.2) + _mod("l_linenumber", 3) * 0.2).alias("shuffled")), "real", "empty", "shuffled")


_PROB = f"{_ONE}, u AS (SELECT l_orderkey, l_linenumber, flag, q / 52::DOUBLE AS re, 0.3::DOUBLE + (l_orderkey % 5) * 0.1::DOUBLE AS em, 0.2::DOUBLE + (l_linenumber % 3) * 0.2::DOUBLE AS sh FROM one), g AS (SELECT *, ln(re) - ln(em) AS gain, ln(re) - ln(sh) AS net FROM u)"


def utility_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.utility_summary(_probabilities(spark, sf_dir), "l_orderkey", "real", "empty"))


def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masses(spark, sf_dir)
    return rounded(E.compare_selectors(m, "l_orderkey", "l_linenumber", {"first": F.lit(True), "supported": F.col("support") >= 0.3, "contradicted": F.col("contradict") >= 0.3}, F.col("flag") == "R"))


def selection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masses(spark, sf_dir).join(_truth(spark, sf_dir), "l_orderkey").select("l_orderkey", "l_linenumber", "support", (F.col("truth") == "SUPPORTS").cast("int").alias("y"), (F.col("flag") == "R").cast("int").alias("d"), F.lit(0).alias("base"))
    return rounded(E.selection_report(rows, "l_orderkey", "l_linenumber", "support", "y", "d", "base", 0.4))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    found = E.search_mappings(li.withColumn("mode", _mod("l_suppkey", 7)), "l_linenumber", "mode", _mod("l_orderkey", 2), F.col("l_quantity") >= 10, F.col("l_returnflag") == "R")
    return rounded(found)


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _probabilities(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("gain", 6).alias("gain"), (F.col("flag") == "R").cast("int").alias("decisive"), _mod("l_linenumber", 4).alias("size"))
    return E.pick_candidate(g, "l_orderkey", "gain", "decisive", "size", "l_linenumber", 0.2)


def focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the line with the greatest share of digits; then of each order only its least line."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    share = F.round(ratio(F.regexp_count("line", F.lit("[0-9]")), F.length("line")), 6)
    return E.focus_passages(lines, "doc_id", "place", F.coalesce(share, F.lit(0.0)))


def single_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.single_claim(masses(spark, sf_dir), "l_orderkey", "l_linenumber").groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("places"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.budget_batches(read(spark, sf_dir, "documents"), "doc_id", "n_chars", batching.Limits(48, padded=60_000))


def flat_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.budget_batches(read(spark, sf_dir, "documents"), "doc_id", "n_chars", batching.Limits(64, flat=30_000))


def tiered_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.budget_batches(read(spark, sf_dir, "documents"), "doc_id", "n_chars", batching.Limits(48, tiers=batching.TIERS))


def matched_donors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of lines, modulo 7, as the number of passages."""
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return donation.next_donors(docs.withColumn("n", F.size(F.split("text", "\n")) % 7), "lang", "doc_id", "n")


def chosen_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with odd numbers as donors of those with even ones, as many as both have; n_chars modulo 50 is the index."""
    docs = read(spark, sf_dir, "documents").filter("n_chars IS NOT NULL").select("doc_id", (F.col("n_chars") % 50).alias("x"))
    sides = [value_places(docs.filter(_mod("doc_id", 2) == k), [], F.col("doc_id").cast("double"), ["doc_id"], "p", "m") for k in (0, 1)]
    n = min(side.count() for side in sides)
    one, two = (side.select((F.col("p") - 1).alias("p"), "x").filter(F.col("p") < n) for side in sides)
    return donation.choose_rotation(one, two, "p", "x")


def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.padding_report(batches(spark, sf_dir), "n_chars")


def _batches(name: str, grows: str) -> str:
    """The greedy pass over the rows one by one: state of the batch that a row joins, or of the one that it opens."""
    return f"""o AS (SELECT doc_id, n_chars AS l, row_number() OVER (ORDER BY n_chars, doc_id) AS i FROM documents WHERE n_chars IS NOT NULL),
w AS (SELECT i, doc_id, l, 0::BIGINT AS batch, 1::BIGINT AS c, l::BIGINT AS t FROM o WHERE i = 1 UNION ALL
SELECT o.i, o.doc_id, o.l, CASE WHEN {grows} THEN batch ELSE batch + 1 END, CASE WHEN {grows} THEN c + 1 ELSE 1 END, CASE WHEN {grows} THEN t + o.l ELSE o.l END FROM w JOIN o ON o.i = w.i + 1),
{name} AS (SELECT doc_id, l AS n_chars, batch FROM w)"""


_PADDED = _batches("r", "c < 48 AND (c + 1) * o.l <= 60000")
_FLAT = _batches("r", "c < 64 AND t + o.l <= 30000")
_TIERED = _batches("r", "c < CASE WHEN o.l <= 600 THEN 48 WHEN o.l <= 900 THEN 32 ELSE 16 END")
_T3 = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) >= 3))"
_D = "sha256('{0}' || chr(31) || {1})"

QUERIES = {
    "aligned_scores": (aligned_scores, f"""
WITH {P}, m AS ({with_confusion("(SELECT *, 'all' AS unit FROM (SELECT * EXCLUDE (unit) FROM p))", "unit")}),
c AS (SELECT count(*) FILTER (label = 1 AND decision = 1) AS tp, count(*) FILTER (label = 0 AND decision = 1) AS fp, count(*) FILTER (label = 0 AND decision = 0) AS tn, count(*) FILTER (label = 1 AND decision = 0) AS fn FROM p),
a AS (SELECT avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS auroc FROM p x JOIN p y ON x.label = 1 AND y.label = 0)
SELECT unit, tp, fp, tn, fn, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(fp / (fp + tn)::DOUBLE, 6) AS fpr, round(ba, 6) AS balanced_accuracy, round(auroc, 6) AS auroc FROM m, c, a"""),
    "aligned_partial": (aligned_partial, f"""
WITH {P} SELECT unit, round(count(*) FILTER (label = 1 AND decision = 1) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE, 6) AS recall, round(count(*) FILTER (label = 0 AND decision = 1) / nullif(count(*) FILTER (label = 0), 0)::DOUBLE, 6) AS fpr
FROM p WHERE index % 3 = 0 GROUP BY unit"""),
    "manifest_report": (manifest_report, "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unavailable' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'selected' END AS status FROM labels"),
    "facts_for_claims": (facts_for_claims, """
WITH q AS (SELECT DISTINCT c_nationkey, CASE WHEN o_orderkey % 11 <> 0 THEN year(o_orderdate)::INT END AS year FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT c_nationkey, CASE WHEN c_custkey % 7 <> 0 THEN 1990 + c_custkey % 9 END AS a, CASE WHEN c_custkey % 5 <> 0 THEN 1990 + c_custkey % 9 + c_custkey % 4 END AS z FROM customer)
SELECT c_nationkey, year, count(*) AS facts FROM q JOIN f USING (c_nationkey) WHERE year IS NULL OR (coalesce(a - 1 <= year, TRUE) AND coalesce(z + 1 >= year, TRUE)) GROUP BY 1, 2"""),
    "overlapping_holders": (overlapping_holders, """
WITH f AS (SELECT s_suppkey AS k, s_nationkey AS o, s_nationkey % 5 AS j, 1990 + s_suppkey % 17 AS a, CASE WHEN s_suppkey % 11 <> 0 THEN 1990 + s_suppkey % 17 + s_suppkey % 3 END AS z FROM supplier)
SELECT DISTINCT x.k AS person, y.k AS other FROM f x JOIN f y ON x.j = y.j AND x.o <> y.o AND x.k <> y.k AND (y.z IS NULL OR x.a <= y.z) AND (x.z IS NULL OR y.a <= x.z)"""),
    "concurrent_offices": (concurrent_offices, """
WITH f AS (SELECT c_custkey AS k, c_custkey % 4 AS o, c_nationkey AS j, c_custkey % 2 AS m, (1900 + c_custkey % 83) * 12 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 9 END AS a, CASE WHEN c_custkey % 13 <> 0 THEN (1900 + c_custkey % 83 + c_custkey % 5) * 12 + 11 END AS z FROM customer)
SELECT x.k AS person, y.k AS other FROM f x JOIN f y ON x.j = y.j AND x.m = 1 AND y.m = 0 AND x.o <> y.o AND (y.z IS NULL OR x.a <= y.z) AND (x.z IS NULL OR y.a <= x.z)"""),
    "relation_evidence": (relation_evidence, """
WITH k AS (SELECT DISTINCT c_custkey, c_nationkey FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0),
c AS (SELECT o_orderkey, max((k.c_nationkey = o_custkey % 25)::INT) AS same, count(k.c_custkey) AS n FROM orders LEFT JOIN k ON o_custkey = k.c_custkey GROUP BY 1)
SELECT CASE WHEN same = 1 THEN 'support' WHEN n = 1 THEN 'counter' ELSE 'neutral' END AS status, count(*) AS claims FROM c GROUP BY 1"""),
    "link_entities": (link_entities, r"""
WITH n AS (SELECT item_id AS entity, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS m FROM benchmark),
q AS (SELECT doc_id AS claim, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) AS m FROM documents WHERE text IS NOT NULL UNION ALL SELECT -entity - 1, m FROM n),
s AS (SELECT claim, entity, CASE WHEN q.m = n.m THEN 100.0 ELSE 20.0 + 10 * len(list_intersect(string_split(q.m, ' '), string_split(n.m, ' '))) END AS score FROM q, n WHERE q.m <> '' AND n.m <> ''),
r AS (SELECT *, row_number() OVER w AS i, lead(score) OVER w AS nx FROM s WHERE score >= 70 WINDOW w AS (PARTITION BY claim ORDER BY score DESC, entity))
SELECT claim, entity, score::DOUBLE AS score FROM r WHERE i = 1 AND (nx IS NULL OR score - nx >= 3)"""),
    "linked_names": (linked_names, r"""
WITH n AS (SELECT DISTINCT item_id AS entity, trim(regexp_replace(lower(unnest([split_part(text, chr(10), 1), string_split(text, chr(10))[-1]])), '[^a-z0-9]+', ' ', 'g')) AS m, text AS about FROM benchmark),
q AS (SELECT doc_id AS claim, split_part(text, chr(10), 1) AS mention, text AS question, lang AS vals FROM documents WHERE text IS NOT NULL UNION ALL SELECT -item_id - 1, string_split(text, chr(10))[-1], text, 'en' FROM benchmark),
k AS (SELECT *, trim(regexp_replace(lower(mention), '[^a-z0-9]+', ' ', 'g')) AS m FROM q),
s AS (SELECT claim, entity, max((k.m = n.m, CASE WHEN k.m = n.m THEN 100.0 ELSE 20.0 + 10 * len(list_intersect(string_split(k.m, ' '), string_split(n.m, ' '))) END::DOUBLE)) AS b FROM k, n WHERE k.m <> '' AND n.m <> '' AND (k.m = n.m OR len(list_intersect(string_split(k.m, ' '), string_split(n.m, ' '))) >= 5) GROUP BY 1, 2),
c AS (SELECT claim, entity, b[2] AS score, {t0} AS q, {t1} AS mt, {t2} AS v, {t3} AS a FROM s JOIN k USING (claim) JOIN (SELECT DISTINCT entity, about FROM n) USING (entity) WHERE NOT regexp_matches(question, '[0-9]') OR contains(lower(about), 'th') OR contains(lower(about), 'en')),
x AS (SELECT claim, entity, score, 12 * len(list_intersect(v, a)) + 3 * len(list_intersect(list_filter(q, lambda w: NOT list_contains(mt, w)), a)) AS context FROM c),
r AS (SELECT *, row_number() OVER w AS i, lead(score) OVER w AS ns, lead(context) OVER w AS nc FROM x WINDOW w AS (PARTITION BY claim ORDER BY score DESC, context DESC, entity))
SELECT claim, entity, score FROM r WHERE i = 1 AND NOT coalesce(score - ns < 3 AND context - nc < 3, FALSE)""".replace("{t0}", _T3.format("question")).replace("{t1}", _T3.format("mention")).replace("{t2}", _T3.format("vals")).replace("{t3}", _T3.format("about"))),
    "assign_donors": (donors, f"""
WITH {P}, u AS (SELECT unit, count(*) AS n, row_number() OVER (ORDER BY {_D.format("donor", "unit")}, unit) - 1 AS u, count(*) OVER () AS k FROM p GROUP BY unit),
x AS (SELECT a.unit, b.unit AS target, b.n AS m FROM u a JOIN u b ON b.u = (a.u + 1) % a.k AND a.k > 1), r AS (SELECT unit, index, row_number() OVER (PARTITION BY unit ORDER BY {_D.format("donor", "index")}, index) - 1 AS i FROM p)
SELECT r.index, d.index AS donor FROM r JOIN x USING (unit) JOIN r d ON d.unit = target AND d.i = (r.i + m // 2) % m"""),
    "composed_prompts": (composed, "SELECT doc_id, quality, lang, md5(text) AS digest FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL"),
    "resolved_redirects": (redirects, """
WITH RECURSIVE e AS (SELECT c_custkey AS name, CASE c_custkey WHEN 3 THEN 6 WHEN 6 THEN 3 ELSE c_custkey // 2 END AS target FROM customer WHERE c_custkey % 7 <> 0),
w AS (SELECT name, target, 1 AS n FROM e UNION ALL SELECT w.name, e.target, n + 1 FROM w JOIN e ON w.target = e.name WHERE n < 40)
SELECT DISTINCT name, target * 10 AS page FROM w WHERE target % 7 = 0 AND target IN (SELECT c_custkey FROM customer)"""),
    "aggregate_evidence": (lambda s, d: rounded(evidence(masses(s, d))), f"WITH {_MASS}, {_verdicts('m', 'v')} SELECT * FROM v"),
    "decision_report": (decision_report, f"""
WITH {_MASS}, {_verdicts("m", "v")}, {_TRUTH} SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (verdict = 'SUPPORTS') AS supports, count(*) FILTER (verdict = 'REFUTES') AS refutes, round(avg((verdict = 'NOT_ENOUGH_INFO')::INT), 6) AS abstained,
round(count(*) FILTER (verdict = truth) / nullif(count(*) FILTER (verdict <> 'NOT_ENOUGH_INFO'), 0)::DOUBLE, 6) AS agreement FROM v JOIN t USING (l_orderkey) GROUP BY 1"""),
    "paired_verdicts": (paired_verdicts, f"""
WITH {_MASS}, n AS (SELECT * REPLACE (l_orderkey + 7 AS l_orderkey) FROM m), {_verdicts("m", "v")}, {_verdicts("n", "w")}, {_TRUTH}, q AS (SELECT v.verdict = truth AS a, w.verdict = truth AS b FROM v JOIN w USING (l_orderkey) JOIN t USING (l_orderkey))
SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS real_only, count(*) FILTER (b AND NOT a) AS shuffled_only, count(*) FILTER (NOT a AND NOT b) AS neither FROM q"""),
    "utility_summary": (utility_summary, f"""
WITH {_PROB}, b AS (SELECT l_orderkey, max(gain) AS best FROM g GROUP BY 1), c AS (SELECT avg(best) AS ceiling, count(*) AS rows FROM b)
SELECT count(*) AS candidates, round(avg(gain), 6) AS mean, round(quantile_cont(gain, 0.5), 6) AS median, round(avg((gain > 0)::INT), 6) AS positive, round(avg(net), 6) AS net,
count(*) FILTER (em < 0.5 AND re >= 0.5) AS rescues, count(*) FILTER (em >= 0.5 AND re < 0.5) AS harms, round(any_value(ceiling), 6) AS ceiling, any_value(rows) AS rows FROM g, c"""),
    "compare_selectors": (selectors, f"""
WITH {_MASS}, s AS (SELECT l_orderkey, l_linenumber, flag, unnest(['first', 'supported', 'contradicted']) AS selector, unnest([TRUE, support >= 0.3, contradict >= 0.3]) AS ok FROM m),
f AS (SELECT selector, l_orderkey, arg_min((flag = 'R')::INT, l_linenumber) FILTER (ok) AS hit, max((flag = 'R')::INT) AS any_ FROM s GROUP BY 1, 2)
SELECT selector, count(hit) AS picked, round(sum(hit) / nullif(count(hit), 0)::DOUBLE, 6) AS precision, round(sum(hit) / sum(any_)::DOUBLE, 6) AS recall FROM f GROUP BY 1"""),
    "selection_report": (selection_report, f"""
WITH {_MASS}, {_TRUTH}, r AS (SELECT l_orderkey, support, (truth = 'SUPPORTS')::INT AS y, (flag = 'R')::INT AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY support DESC, l_linenumber) AS i FROM m JOIN t USING (l_orderkey)),
c AS (SELECT y, support >= 0.4 AS used, CASE WHEN support >= 0.4 THEN d ELSE 0 END = y AS ok, y = 0 AS was FROM r WHERE i = 1)
SELECT count(*) AS rows, round(avg(used::INT), 6) AS coverage, count(*) FILTER (ok AND NOT was) AS helped, count(*) FILTER (was AND NOT ok) AS harmed, round(count(*) FILTER (was AND NOT ok) / nullif(count(*) FILTER (used), 0)::DOUBLE, 6) AS harm_rate,
round(avg(was::INT), 6) AS before, round(avg(ok::INT), 6) AS after, round((avg(ok::INT - was::INT) FILTER (y = 0) + avg(ok::INT - was::INT) FILTER (y = 1)) / 2, 6) AS balanced_gain FROM c"""),
    "predicate_mappings": (mappings, """
WITH c AS (SELECT l_linenumber, l_suppkey % 7 AS mode, count(*) FILTER (l_orderkey % 2 = 0 AND l_quantity >= 10) AS covered_0, count(*) FILTER (l_orderkey % 2 = 0 AND l_quantity >= 10 AND l_returnflag = 'R') AS hits_0,
           count(*) FILTER (l_orderkey % 2 = 1 AND l_quantity >= 10) AS covered_1, count(*) FILTER (l_orderkey % 2 = 1 AND l_quantity >= 10 AND l_returnflag = 'R') AS hits_1 FROM lineitem GROUP BY 1, 2),
w AS (SELECT *, least(coalesce(hits_0 / nullif(covered_0, 0)::DOUBLE, 0), coalesce(hits_1 / nullif(covered_1, 0)::DOUBLE, 0)) AS worse FROM c)
SELECT l_linenumber, mode, covered_0, hits_0, covered_1, hits_1, round(worse, 6) AS worse_precision, row_number() OVER (PARTITION BY l_linenumber ORDER BY worse DESC, hits_0 + hits_1 DESC, mode) AS place FROM w"""),
    "picked_candidates": (picks, f"""
WITH {_PROB}, h AS (SELECT l_orderkey, l_linenumber AS c, round(gain, 6) AS gain, flag, l_linenumber % 4 AS size FROM g)
SELECT l_orderkey, (arg_min(c, (gain, c)) FILTER (gain < -0.2 AND flag <> 'R')) AS harmful, (arg_min(c, (-gain, c)) FILTER (gain > 0.2)) AS helpful, (arg_min(c, (size, c)) FILTER (abs(gain) <= 0.2)) AS rejected FROM h GROUP BY 1"""),
    "focus_passages": (focus, """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS place FROM documents),
s AS (SELECT doc_id, place, coalesce(round(len(regexp_extract_all(line, '[0-9]')) / nullif(length(line), 0)::DOUBLE, 6), 0.0) AS relevance FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, place) AS i FROM s) SELECT doc_id, place, relevance FROM r WHERE i = 1"""),
    "single_claims": (single_claims, f"WITH {_MASS}, k AS (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS a FROM m) SELECT flag, count(*) AS n, sum(l_linenumber)::BIGINT AS places FROM k WHERE a = l_linenumber GROUP BY 1"),
    "paired_rows": (lambda s, d: E.pair_rows(predictions(s, d), "unit", "index"), f"""
WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY unit, label ORDER BY {_D.format("pair", "index")}, index) AS i, least(count(*) FILTER (label = 1) OVER (PARTITION BY unit), count(*) FILTER (label = 0) OVER (PARTITION BY unit)) AS n FROM p)
SELECT index, CASE WHEN i <= n THEN {_D.format("pair", "unit || chr(31) || i")} ELSE {_D.format("pair-alone", "index")} END AS block, CASE WHEN i <= n THEN label ELSE 0 END AS within FROM r"""),
    "blocked_rows": (lambda s, d: E.block_order(predictions(s, d), "unit", "index", 8), f"""
WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY unit, label ORDER BY {_D.format("block", "index")}, index) - 1 AS i, least(count(*) FILTER (label = 1) OVER (PARTITION BY unit) // 4, count(*) FILTER (label = 0) OVER (PARTITION BY unit) // 4) * 4 AS n FROM p)
SELECT index, CASE WHEN i < n THEN 'full' ELSE 'rest' END AS kind, CASE WHEN i < n THEN unit || ':' || (i // 4) END AS block FROM r"""),
    "budget_batches": (batches, f"WITH RECURSIVE {_PADDED} SELECT * FROM r"),
    "flat_batches": (flat_batches, f"WITH RECURSIVE {_FLAT} SELECT * FROM r"),
    "tiered_batches": (tiered_batches, f"WITH RECURSIVE {_TIERED} SELECT * FROM r"),
    "batch_padding": (padding, f"""
WITH RECURSIVE {_PADDED}, b AS (SELECT count(*) AS n, max(n_chars) AS m, sum(n_chars) AS s FROM r GROUP BY batch)
SELECT count(*) AS batches, max(n) AS most_rows, max(n * m) AS most_padded, sum(n * m - s)::BIGINT AS padding FROM b"""),
    "matched_donors": (matched_donors, """
WITH r AS (SELECT lang AS unit, doc_id, len(string_split(text, chr(10))) % 7 AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY n) AS m FROM r),
f AS (SELECT a.doc_id, arg_min(b.doc_id, (b.i - a.i + a.m) % a.m) AS donor FROM p a JOIN p b ON a.n = b.n AND a.unit <> b.unit WHERE a.n > 0 GROUP BY 1)
SELECT doc_id, donor FROM r LEFT JOIN f USING (doc_id)"""),
    "chosen_rotation": (chosen_rotation, """
WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, n_chars % 50 AS x FROM documents WHERE doc_id % 2 = 0 AND n_chars IS NOT NULL), b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, n_chars % 50 AS x FROM documents WHERE doc_id % 2 = 1 AND n_chars IS NOT NULL),
k AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n), s AS (SELECT unnest(range(0, n)) AS shift, n FROM k),
c AS (SELECT s.shift, count(b.p) AS repeats FROM s JOIN a ON a.p < s.n LEFT JOIN b ON b.p = (a.p + s.shift) % s.n AND b.x = a.x GROUP BY 1)
SELECT shift, repeats FROM c ORDER BY repeats, shift LIMIT 1"""),
}
