"""Queries of names, JSON, overlaps, facts, transcripts, records, variants and their audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as T
from ..operators import conversations, records
from ..operators import relations as R
from ..sources.tables import predictions, read, second_predictions
from .common import P, rounded

SPLITS, BASES = ["train", "train-extra", "test"], ["alpha-7b", "beta-13b"]
#: Names that stand for tasks.
CODENAMES = ["amber", "birch", "cedar", "delta", "ember", "flint", "grove"]
_TEMPLATES = [("judge", "Is this true?", "Answer:"), ("rate", "Rate the text.", "Rating:")]


def _mod(column: str, n: int):
    return F.pmod(F.col(column), F.lit(n))


def dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (_mod(c, len(xs)) + 1).cast("int"))
    name = F.concat(F.lit("org/"), pick(SPLITS, "o_orderkey"), F.lit("-"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", "")), F.lit("-"), pick(BASES, "o_custkey"), pick(["", "-none", "-lora-x2"], "o_custkey"))
    return o.select("o_orderkey", T.parse_dataset_name(name, SPLITS, BASES).alias("p")).select("o_orderkey", "p.*")


def codenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    redacted = T.redact_names(F.concat(F.lit("sold to "), "c_mktsegment"), {"FURNITURE": "tasks-1", "AUTOMOBILE": "tasks-2"})
    return c.select("c_custkey", T.codename(F.col("c_name"), CODENAMES).alias("codename"), redacted.alias("redacted"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(x) for x in ("White-Box", " black_box", "WHITE", "grey", "black box ")]), (_mod("doc_id", 5) + 1).cast("int"))
    return read(spark, sf_dir, "documents").groupBy(T.normalize_tag(raw).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The props of events inside an object inside a text, behind braces that hold no JSON; every ninth text has none."""
    e = read(spark, sf_dir, "events")
    props = F.concat(F.lit('{"in": {"x": "a}b{\\"", "y": [{}]}, '), F.substring(F.col("props"), 2, F.length("props")))
    text = F.concat(F.lit('see {this} {"a": {"b": '), F.when(_mod("event_id", 9) != 0, props).otherwise(""), F.lit(" {not: json}"))
    parsed = T.parse_json_enum(text, {"k": ["1", "2", "3"]}, ["k", "why"])
    return e.select(parsed.alias("p")).groupBy(F.col("p.value").isNotNull().alias("found"), F.array_join("p.errors", ",").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def hashed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    named = F.transform(T.terms(F.col("text")), lambda t: F.struct(F.concat(F.lit("term="), t).alias("name"), F.lit(1.0).alias("value")))
    return T.hash_features(docs, "doc_id", named)


def _with_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside the benchmark item of its number."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("item_id", _mod("doc_id", 40))
    return docs.join(items, "item_id")


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; the title of a document is its first line."""
    q, s = F.col("item"), F.col("text")
    scores = {
        "relevance": T.lexical_relevance(q, s),
        "title": T.title_overlap(q, F.substring_index(s, "\n", 1)),
        "number_recall": T.number_recall(s, q),
        "length": T.length_similarity(q, s),
        "rrf": T.reciprocal_rank(_mod("doc_id", 10)),
    }
    return rounded(_with_item(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in scores.items()]))


def recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line is the conversation so far, the whole text the target."""
    recall = T.token_recall(F.substring_index("text", "\n", 1), F.col("text"), F.col("item"))
    return rounded(_with_item(spark, sf_dir).select("doc_id", recall.alias("r")).select("doc_id", "r.*"))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of customers against answers that restate them, deny them, or speak of something else."""
    c = read(spark, sf_dir, "customer")
    s = F.concat(F.lit("customer "), F.col("c_mktsegment"), F.lit(" pays number "), F.col("c_nationkey"))
    turned = F.concat(F.lit("customer "), F.col("c_mktsegment"), F.lit(" never pays number "), F.col("c_nationkey"))
    answer = F.when(_mod("c_custkey", 4) == 0, F.concat(F.lit("False. "), s)).when(_mod("c_custkey", 4) == 1, F.concat(F.lit("True; "), turned)).when(_mod("c_custkey", 4) == 2, F.concat(F.lit("True. "), s)).otherwise("false: nothing like it")
    state = F.when(_mod("c_custkey", 3) == 0, "it is open now").when(_mod("c_custkey", 3) == 1, "closed or open").otherwise("it is closed")
    passage = F.concat(F.lit("between "), F.col("c_nationkey"), F.when(_mod("c_custkey", 2) == 0, F.lit(" and 999")).otherwise(""))
    return c.select("c_custkey", T.verdict_conflict(s, answer).alias("conflict"), T.value_disagreement(F.lit("The state is open."), state, ["open", "closed"]).alias("disagree"), T.repeats_question_value(s, passage).alias("repeats"))


def parsed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    text = F.concat(F.lit("ordered by: Customer "), F.col("o_custkey"), F.when(_mod("o_orderkey", 3) != 0, F.concat(F.lit(" [in "), F.year("o_orderdate"), F.lit("; status "), F.col("o_orderstatus"), F.lit("]"))).otherwise(""))
    return o.select("o_orderkey", T.parse_fact(text).alias("f")).select("o_orderkey", "f.predicate", "f.value", F.array_join("f.qualifiers", "|").alias("qualifiers"), F.array_join("f.years", "|").alias("years"), "f.decade")


def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = F.create_map(F.lit("yes"), -F.col("value") / 100, F.when(_mod("event_id", 7) == 0, F.lit("other")).otherwise("no"), -(_mod("user_id", 10) / 5.0))
    return rounded(read(spark, sf_dir, "events").select("event_id", T.margin(logs, "yes", "no").alias("margin"), T.binary_softmax(logs, "yes", "no").alias("p")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns as an array, an object, a bare text, or nothing."""
    t = read(spark, sf_dir, "conversations").filter("turn = 0").groupBy("conv_id").agg(F.min_by(F.struct("role", F.col("text").alias("content")), F.coalesce("text", F.lit(""))).alias("m"))
    k = _mod("conv_id", 4)
    raw = F.when(k == 0, F.to_json(F.array("m", "m"))).when(k == 1, F.to_json("m")).when(k == 2, F.concat(F.lit("> "), F.coalesce("m.content", F.lit(""))))
    return t.select("conv_id", T.normalize_messages(raw).alias("n")).select("conv_id", F.size("n").alias("messages"), F.array_join(F.transform("n", lambda m: m["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("n", lambda m: m["content"]), "\n")).alias("digest"))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the rendered transcripts."""
    t = read(spark, sf_dir, "conversations").filter("role IN ('system', 'user', 'assistant')")
    return conversations.render_dialogue(t).select("conv_id", T.final_exchange(F.col("dialogue")).alias("x")).select("conv_id", F.md5("x.question").alias("question"), F.md5("x.answer").alias("answer"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('He said "the first part" in 1999 and **Bold Words**. '), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(T.extract_spans(text, 5), "|").alias("spans"), F.array_join(T.relation_names(text, [("says", "said|says"), ("numbers", "[0-9]{3}")]), "|").alias("relations"))


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL")
    refs = docs.filter(_mod("doc_id", 3) == 0).select("doc_id", F.col("lang").alias("reference"))
    templates = spark.createDataFrame(_TEMPLATES, "template string, head string, tail string")
    return records.assemble(docs, templates, "doc_id", "text", refs).select("doc_id", "template", F.md5("record").alias("digest"))


def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    parts = {n: docs.filter(_mod("doc_id", 4) == k) for k, n in enumerate(("a", "b", "c"))}
    return records.union_tagged(parts, "doc_id").groupBy("origin", "lang").agg(F.count(F.lit(1)).alias("n"))


def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.keys_intersect(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").cast("double").alias("places"), F.max("l_quantity").cast("double").alias("quantity"))
    return rounded(records.unpivot(c, ["l_orderkey"], ["places", "quantity"], scale=8.0))


def flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as claims that quote their beginning; every third quote is made up."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    claim = lambda line, i: F.struct(F.md5(line).alias("claim"), F.when(i % 3 == 2, F.concat(F.left(line, F.lit(12)), F.lit("#~#"))).otherwise(F.left(line, F.lit(12))).alias("quote"))
    return records.flatten_claims(docs.withColumn("claims", F.transform(F.split("text", "\n"), claim)), "doc_id", "claims", "text").select("doc_id", "position", "claim", F.md5("quote").alias("quote"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.coalesce("text", F.lit("")).alias("text"))
    return records.expand_variants(p.select("index").join(docs, "index"), "index", "text", R.assign_donors(p, "unit", "index")).select("index", "variant", F.md5("evidence").alias("digest"), "origin")


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    other = second_predictions(p)
    return rounded(records.feature_bank(p.select("index", "label"), {"length": p.select("index", "score"), "place": other.filter(_mod("index", 5) != 0).select("index", "score")}, "index"))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "lang", "source", F.col("text").alias("prompt"))
    out = lambda c: docs.select("doc_id", "prompt", c.alias("output"))
    plain = F.concat(F.lit("about "), F.col("lang"))
    real = F.when(_mod("doc_id", 2) == 0, F.concat(plain, F.lit(" taken from "), F.col("source"), F.lit("page"))).otherwise(plain)
    shuffled = F.when(_mod("doc_id", 10) == 0, F.concat(plain, F.lit(" otherwise"))).otherwise(plain)
    return records.audit_conditions(out(plain), out(real), out(shuffled), docs.select("doc_id", F.concat(F.col("source"), F.lit("page")).alias("evidence")), "doc_id")


def variant_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").withColumn("variant", F.explode(F.array(F.lit("real"), F.lit("empty"))))
    label = F.when((_mod("doc_id", 11) == 0) & (F.col("variant") == "empty"), 1 - F.col("quality")).otherwise(F.col("quality"))
    text = F.when(_mod("doc_id", 13) == 0, "").otherwise(F.concat(F.when(_mod("doc_id", 7) == 0, F.lit("<e></e><e></e>")).otherwise("<e></e>"), F.when(_mod("doc_id", 17) == 0, F.lit(" label=1")).otherwise("")))
    return records.audit_variants(labels.select("doc_id", "variant", label.alias("label"), text.alias("text")), "doc_id", "variant", "label", "text", "<e>", "label=[01]")


def label_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    return records.mark_label_only(labels, labels.filter(_mod("doc_id", 6) == 0), "doc_id", "quality").groupBy("label_only", "quality").agg(F.count(F.lit(1)).alias("n"))


def _terms(t: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda w: length(w) >= 4))"


def _numbers(t: str) -> str:
    return f"list_distinct(regexp_extract_all({t}, '[0-9]+'))"


def _share(part: str, whole: str) -> str:
    return f"len(list_intersect({whole}, {part})) / greatest(1, len({whole}))::DOUBLE"


_ITEMS = "j AS (SELECT d.doc_id, d.text, d.text AS s, b.text AS q FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40 WHERE d.text IS NOT NULL)"
_SPANS = """list_concat(list_concat(regexp_extract_all(t, '\\*\\*([^*]+)\\*\\*', 1), regexp_extract_all(t, '"([^"]{2,80})"', 1)), list_concat(regexp_extract_all(t, '([A-Z][a-z]+ [A-Z][a-z]+)', 1), regexp_extract_all(t, '(1[5-9][0-9]{2}|20[0-9]{2})', 1)))"""

QUERIES = {
    "dataset_names": (dataset_names, """
WITH n AS (SELECT o_orderkey, ['train', 'train-extra', 'test'][(o_orderkey % 3 + 1)::INT] AS split, lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '', 'g')) AS task, ['alpha-7b', 'beta-13b'][(o_custkey % 2 + 1)::INT] AS model_id, o_custkey % 3 AS l FROM orders)
SELECT o_orderkey, split, task, model_id, CASE WHEN l = 2 THEN 'lora-x2' END AS lora_id FROM n"""),
    "codenames": (codenames, f"""
WITH h AS (SELECT *, list_reduce(list_transform(range(0, 8), lambda k: ('0x' || sha256(c_name)[8 * k + 1:8 * k + 8])::BIGINT), lambda a, x: (a % 7 * {2**32 % 7} + x) % 7) AS i FROM customer)
SELECT c_custkey, {CODENAMES}[(i % 7 + 1)::INT] AS codename, replace(replace('sold to ' || c_mktsegment, 'AUTOMOBILE', 'tasks-2'), 'FURNITURE', 'tasks-1') AS redacted FROM h"""),
    "normalized_tags": (tags, "SELECT CASE doc_id % 5 WHEN 3 THEN NULL WHEN 0 THEN 'white' WHEN 2 THEN 'white' ELSE 'black' END AS tag, count(*) AS n FROM documents GROUP BY 1"),
    "json_fields": (json_fields, """
WITH e AS (SELECT CASE WHEN event_id % 9 <> 0 THEN props END AS v FROM events), f AS (SELECT v, v->>'k' AS k, v->>'why' AS why FROM e)
SELECT v IS NOT NULL AS found, concat_ws(',', CASE WHEN coalesce(k, '') NOT IN ('1', '2', '3') THEN 'k' END, CASE WHEN coalesce(trim(k), '') = '' THEN 'k' END, CASE WHEN coalesce(trim(why), '') = '' THEN 'why' END) AS errors, count(*) AS n FROM f GROUP BY 1, 2"""),
    "hashed_features": (hashed_features, None),
    "lexical_relevance": (relevance, f"""
WITH {_ITEMS} SELECT doc_id, round({_share(_terms("s"), _terms("q"))} + CASE WHEN len(list_intersect({_numbers("q")}, {_numbers("s")})) > 0 THEN 0.5 ELSE 0 END, 6) AS relevance, round({_share(_terms("q"), _terms("split_part(text, chr(10), 1)"))}, 6) AS title,
round(CASE WHEN len({_numbers("s")}) = 0 THEN 1.0 ELSE {_share(_numbers("q"), _numbers("s"))} END, 6) AS number_recall, round(CASE WHEN greatest(length(q), length(text)) = 0 THEN 1.0 ELSE least(length(q), length(text)) / greatest(length(q), length(text))::DOUBLE END, 6) AS length, round(1 / (2 + doc_id % 10)::DOUBLE, 6) AS rrf FROM j"""),
    "token_recalls": (recalls, f"""
WITH {_ITEMS}, t AS (SELECT doc_id, {_terms("split_part(text, chr(10), 1)")} AS c, {_terms("text")} AS t, {_terms("q")} AS e FROM j), n AS (SELECT *, list_filter(t, lambda w: NOT list_contains(c, w)) AS n FROM t)
SELECT doc_id, round({_share("e", "n")}, 6) AS novel, round({_share("e", "t")}, 6) AS recall, round({_share("t", "e")}, 6) AS precision FROM n"""),
    "conflicts": (conflicts, """
SELECT c_custkey, c_custkey % 4 IN (0, 1) AS conflict, c_custkey % 3 = 2 AS disagree, c_custkey % 2 = 1 AS repeats FROM customer"""),
    "parsed_facts": (parsed_facts, """
SELECT o_orderkey, 'ordered by' AS predicate, 'Customer ' || o_custkey AS value, CASE WHEN o_orderkey % 3 <> 0 THEN 'in ' || year(o_orderdate) || '|status ' || o_orderstatus ELSE '' END AS qualifiers,
concat_ws('|', CASE WHEN length(o_custkey::VARCHAR) = 4 AND o_custkey BETWEEN 1500 AND 2200 THEN o_custkey::VARCHAR END, CASE WHEN o_orderkey % 3 <> 0 AND year(o_orderdate) <> o_custkey THEN year(o_orderdate)::VARCHAR END) AS years,
((CASE WHEN o_custkey BETWEEN 1500 AND 2200 THEN o_custkey WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) END) // 10 * 10)::INT AS decade FROM orders"""),
    "margins": (margins, """
WITH m AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN -value / 100 + (user_id % 10) / 5.0::DOUBLE END AS m FROM events) SELECT event_id, round(m, 6) AS margin, round(1 / (1 + exp(-m)), 6) AS p FROM m"""),
    "normalized_messages": (messages, """
WITH t AS (SELECT conv_id, arg_min(role, coalesce(text, '')) AS role, min(coalesce(text, '')) AS c FROM conversations WHERE turn = 0 GROUP BY 1)
SELECT conv_id, [2, 1, 1, 0][(conv_id % 4 + 1)::INT] AS messages, CASE conv_id % 4 WHEN 0 THEN role || ',' || role WHEN 1 THEN role WHEN 2 THEN 'user' ELSE '' END AS roles, md5(CASE conv_id % 4 WHEN 0 THEN c || chr(10) || c WHEN 1 THEN c WHEN 2 THEN '> ' || c ELSE '' END) AS digest FROM t"""),
    "final_exchanges": (exchanges, """
WITH r AS (SELECT conv_id, role, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, coalesce(text, '') DESC) AS i FROM conversations WHERE role IN ('system', 'user', 'assistant'))
SELECT conv_id, md5(max(t) FILTER (role = 'user' AND i = 1)) AS question, md5(max(t) FILTER (role = 'assistant' AND i = 1)) AS answer FROM r GROUP BY 1"""),
    "linked_spans": (spans, f"""
WITH d AS (SELECT doc_id, 'He said "the first part" in 1999 and **Bold Words**. ' || coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, t, list_transform({_SPANS}, lambda x: trim(x)) AS a FROM d),
l AS (SELECT doc_id, t, a, list_transform(a, lambda x: lower(x)) AS b FROM s)
SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(b, lower(x)) = i)[1:5], '|') AS spans, 'says|numbers' AS relations FROM l"""),
    "assembled_records": (assembled, """
SELECT doc_id, t.template, md5(t.head || chr(10) || CASE WHEN doc_id % 3 = 0 AND lang IS NOT NULL THEN '<reference>' || lang || '</reference>' || chr(10) ELSE '' END || text || chr(10) || t.tail) AS digest
FROM documents, (VALUES ('judge', 'Is this true?', 'Answer:'), ('rate', 'Rate the text.', 'Rating:')) t(template, head, tail) WHERE text IS NOT NULL"""),
    "tagged_union": (tagged_union, "SELECT ['a', 'b', 'c'][(doc_id % 4 + 1)::INT] AS origin, lang, count(*) AS n FROM documents WHERE doc_id % 4 < 3 GROUP BY 1, 2"),
    "shared_keys": (shared_keys, "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders"),
    "unpivoted_members": (unpivoted, "WITH c AS (SELECT l_orderkey, sum(l_linenumber)::DOUBLE AS places, max(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1) SELECT l_orderkey, 'places' AS member, round(places / 8, 6) AS value FROM c UNION ALL SELECT l_orderkey, 'quantity', round(quantity / 8, 6) FROM c"),
    "flattened_claims": (flattened, """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS position FROM documents),
c AS (SELECT doc_id, text, position, md5(line) AS claim, left(line, 12) || CASE WHEN position % 3 = 2 THEN '#~#' ELSE '' END AS quote FROM l)
SELECT doc_id, min(position) AS position, claim, md5(arg_min(quote, position)) AS quote FROM c WHERE quote <> '' AND contains(text, quote) GROUP BY doc_id, claim"""),
    "expanded_variants": (variants, f"""
WITH {P}, u AS (SELECT unit, count(*) AS n, row_number() OVER (ORDER BY sha256('donor' || chr(31) || unit), unit) - 1 AS u, count(*) OVER () AS k FROM p GROUP BY unit),
x AS (SELECT a.unit, b.unit AS target, b.n AS m FROM u a JOIN u b ON b.u = (a.u + 1) % a.k AND a.k > 1), r AS (SELECT unit, index, row_number() OVER (PARTITION BY unit ORDER BY sha256('donor' || chr(31) || index), index) - 1 AS i FROM p),
g AS (SELECT r.index, d.index AS donor FROM r JOIN x USING (unit) JOIN r d ON d.unit = target AND d.i = (r.i + m // 2) % m), t AS (SELECT index, md5(coalesce(text, '')) AS h FROM p JOIN documents ON doc_id = index)
SELECT index, 'real' AS variant, h AS digest, index AS origin FROM t UNION ALL SELECT index, 'empty', md5(''), NULL FROM t UNION ALL SELECT g.index, 'shuffled', h, donor FROM g JOIN t ON t.index = donor"""),
    "feature_bank": (bank, f"WITH {P} SELECT index, label, round(score, 6) AS length, round(CASE WHEN index % 5 <> 0 THEN (index % 97) / 97.0::DOUBLE ELSE 0.5 END, 6) AS place FROM p"),
    "condition_audit": (conditions, f"""
WITH d AS (SELECT *, 'about ' || lang AS a, source || 'page' AS e FROM documents WHERE text IS NOT NULL), o AS (SELECT doc_id, e, a, CASE WHEN doc_id % 2 = 0 THEN a || ' taken from ' || e ELSE a END AS b, CASE WHEN doc_id % 10 = 0 THEN a || ' otherwise' ELSE a END AS c FROM d),
n AS (SELECT *, list_filter({_terms("b")}, lambda w: NOT list_contains({_terms("a")}, w)) AS n FROM o)
SELECT count(*) AS rows, count(*) AS same_prompts, count(*) FILTER (a IS DISTINCT FROM b) AS changed_real, count(*) FILTER (a IS DISTINCT FROM c) AS changed_shuffled, sum(coalesce(len(n), 0))::BIGINT AS new_terms, sum(coalesce(len(list_intersect(n, {_terms("e")})), 0))::BIGINT AS grounded_terms FROM n"""),
    "variant_audit": (variant_audit, """
WITH l AS (SELECT count(*) FILTER (doc_id % 13 = 0) * 2 AS empty, count(*) FILTER (doc_id % 11 = 0) AS labels, count(*) FILTER (doc_id % 13 = 0 OR doc_id % 7 = 0) * 2 AS blocks, count(*) FILTER (doc_id % 17 = 0 AND doc_id % 13 <> 0) * 2 AS leaks,
greatest(0, abs(count(*) FILTER (quality = 1 AND doc_id % 11 <> 0) - count(*) FILTER (quality = 0 OR doc_id % 11 = 0)) - 1) AS imbalance FROM labels)
SELECT 'repeated' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'empty', empty FROM l UNION ALL SELECT 'labels', labels FROM l UNION ALL SELECT 'blocks', blocks FROM l UNION ALL SELECT 'leaks', leaks FROM l UNION ALL SELECT 'imbalance', imbalance FROM l"""),
    "label_only_marks": (label_only, "SELECT doc_id % 6 = 0 AS label_only, quality, count(*) AS n FROM labels GROUP BY 1, 2"),
}

