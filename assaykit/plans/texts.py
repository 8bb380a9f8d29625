"""Queries of number words, negated cues, clauses, visible parts, text features and the shape of conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import text as T
from ..operators import audits, conversations
from ..sources.tables import read
from .common import rounded

CUES = "however|because|therefore|the"
#: Frequent words of the test tables stand for cues and negations that their invented prose lacks.
CLAUSE_CUES, NEGATIONS = "the|und|les|para", "not|never|no|of|le|der|que"
SHAPES = [["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user", "assistant"]]
MOST_CHARS = 400


def _docs(make):
    return lambda spark, sf: read(spark, sf, "documents").select("doc_id", *make(F.col("text")))


def salient_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = read(spark, sf_dir, "documents").select("lang", F.explode(T.salient_values(F.col("text"))).alias("v"))
    return values.groupBy("lang", "v.kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v.value").alias("distinct_values"))


def value_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words around the greatest salient value of every document that has one."""
    docs = read(spark, sf_dir, "documents").withColumn("v", F.array_max(T.salient_values(F.col("text")))).filter("v IS NOT NULL")
    words = docs.select("doc_id", "v.kind", "v.value", T.value_context(F.col("text"), F.col("v.kind"), F.col("v.value")).alias("w"))
    return words.select("doc_id", "kind", "value", F.size("w").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their tags: behind the last of two, and both sides of two closing tags."""
    html = F.col("html")
    head, nav = T.split_reasoning(html, "head"), T.split_reasoning(html, "nav")
    kept = read(spark, sf_dir, "pages").select("page_id", T.visible_part(html, ["</p>", "</article>"]).alias("last"), head.alias("h"), nav.alias("n"), T.split_reasoning(html).alias("none"))
    digest = {"last": "last", "head": "h.reasoning", "body": "h.visible", "before_nav": "n.reasoning", "after_nav": "n.visible", "thought": "none.visible"}
    return kept.select("page_id", *[F.md5(c).alias(name) for name, c in digest.items()])


def role_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of one of three shapes whose user texts are short enough."""
    t = read(spark, sf_dir, "conversations")
    out = None
    for roles in SHAPES:
        found = conversations.has_roles(t, roles, MOST_CHARS, of="user").select("conv_id", F.lit(">".join(roles)).alias("shape"))
        out = found if out is None else out.unionByName(found)
    return out


def final_reasonings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several lines of a turn stands for its reasoning."""
    t = read(spark, sf_dir, "conversations").withColumn("reasoning", F.when(F.col("text").contains("\n"), F.substring_index("text", "\n", 1)))
    return conversations.final_reasoning(t).select("conv_id", F.md5("reasoning").alias("digest"))


#: The invented prose has few relations; frequent words stand for what a question asks.
_WORD = r"(?:^|[^\p{{L}}])(?:{})(?:$|[^\p{{L}}])"
RELATIONS = [
    ("place", _WORD.format("in|on"), ["country", "city", "located in"]),
    ("time", _WORD.format("by|this"), ["date of birth", "date of death"]),
    ("people", _WORD.format("are|you|he"), ["member of", "winner"]),
]
GROUPS = [
    (["country", "city", "located in"], [(_WORD.format("on"), ["city"]), (_WORD.format("here"), ["located in"]), (_WORD.format("the"), ["country", "located in"])], True),
    (["date of birth", "date of death"], [(_WORD.format("is"), ["date of birth"]), (_WORD.format("to"), ["date of death"])], False),
    (["winner", "member of"], [(_WORD.format("was"), ["winner"])], False),
]


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's first line as the question, the rest as its answer."""
    docs = read(spark, sf_dir, "documents")
    question, answer = F.substring_index("text", "\n", 1), F.when(F.col("text").contains("\n"), F.substring(F.col("text"), F.locate("\n", F.col("text")) + 1, F.length("text")))
    x = docs.select("doc_id", C.extract_claim(question, answer, RELATIONS, GROUPS).alias("x"))
    return x.select("doc_id", *[F.array_join(f"x.{c}", "|").alias(c) for c in ("subjects", "values", "qualifiers", "relations", "predicates")])


def text_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = conversations.text_views(read(spark, sf_dir, "conversations"), 300, ["system", "user"])
    return v.select("conv_id", *[F.md5(c).alias(c) for c in ("output", "context", "both")])


def reused_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of documents from a cache of which every fifth entry did not parse; of one source there is no evidence."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.when(F.col("source") != "src1", F.col("source")).alias("evidence"))
    hashed = F.sha2(F.concat_ws("\x1f", "text", "lang"), 256)
    cache = docs.filter("doc_id % 3 <> 0").select("doc_id", hashed.alias("hash"), F.lit(-1).alias("size"), (F.col("doc_id") % 5 != 0).cast("int").alias("parsed"))
    empty = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit(-2).alias("size"))
    return audits.reuse_or_compute(docs, cache, "doc_id", ["text", "lang"], "size", F.length("text"), "parsed", "evidence", empty).select("doc_id", "reused", "size")


_WORDS = ", ".join(f"('{w}', '{kind}', '{i}')" for kind, words in (("cardinal", T.CARDINALS), ("ordinal", T.ORDINALS)) for i, w in enumerate(words))


def _values(table: str, keys: str) -> str:
    """Kinds and values of each row of a table with a text."""
    kind = "CASE WHEN v LIKE '%\\%' ESCAPE '\\' THEN 'percent' WHEN regexp_matches(v, '^[0-9]+(st|nd|rd|th)$') THEN 'ordinal' WHEN length(regexp_extract(v, '^[0-9]+')) = 4 AND regexp_extract(v, '^[0-9]+')::INT BETWEEN 1500 AND 2200 THEN 'year' ELSE 'cardinal' END"
    return f"""(
SELECT {keys}, kind, CASE WHEN kind IN ('ordinal', 'cardinal') THEN regexp_extract(v, '^[0-9]+') ELSE v END AS value FROM (SELECT {keys}, v, {kind} AS kind FROM
 (SELECT {keys}, unnest(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]*|{T.NUMBER}'), lambda x: regexp_matches(x, '^[0-9]')), lambda x: replace(x, ',', ''))) AS v FROM {table}))
UNION SELECT {keys}, kind, value FROM (SELECT {keys}, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM {table}) JOIN (VALUES {_WORDS}) w(word, kind, value) USING (word))"""


_STOP = ", ".join(f"'{w}'" for w in sorted({*T.STOP_WORDS, *T.CARDINALS, *T.ORDINALS}))
_BOUND = {"begin": r"\b", "end": r"\b", "fresh": "(?:^|[^A-Za-z0-9_])"}


def _flags(cues: str, negations: str) -> str:
    """Cues of each document with the 80 characters before them, found by their places."""
    pattern = rf"(?i)\b(?:{cues})\b"
    return rf"""
x AS (SELECT doc_id, unnest(string_split_regex(text, '{pattern}')) AS piece, unnest(regexp_extract_all(text, '{pattern}')) AS cue, generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS i FROM documents),
o AS (SELECT doc_id, cue, sum(length(piece) + coalesce(length(cue), 0)) OVER (PARTITION BY doc_id ORDER BY i) - length(cue) AS ends FROM x),
f AS (SELECT doc_id, bool_or(NOT regexp_matches(substr(text, greatest(1, ends - 79)::BIGINT, least(80, ends)::BIGINT), '(?i)(?:^|[^A-Za-z0-9_])(?:{negations})(?:\s+[A-Za-z0-9_'']+){{0,5}}\s*\z')) AS flag FROM o JOIN documents USING (doc_id) WHERE cue IS NOT NULL GROUP BY 1)"""


def _counts() -> str:
    count = lambda p: "len(regexp_extract_all(text, '{}'))::INT".format(p.replace("'", "''"))
    n = {name: count(p) for name, p in T.feature_patterns(**_BOUND).items()}
    density = " + ".join(n[name] for name in ("numbers", "currencies", "quoted", "capitalised", "comparatives", "causals"))
    return ", ".join(f"{c} AS {name}" for name, c in n.items()) + f", {density} AS density"


_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _behind(text: str, marker: str) -> str:
    """What follows the last occurrence of a marker."""
    return f"string_split({text}, '{marker}')[-1]"


def _before(tag: str) -> str:
    return f"CASE WHEN contains(html, '</{tag}>') THEN {_TRIM.format(f'string_split(html, {chr(39)}</{tag}>{chr(39)})[1]')} END"


def _after(tag: str) -> str:
    return f"CASE WHEN contains(html, '</{tag}>') THEN {_TRIM.format(f'substr(html, strpos(html, {chr(39)}</{tag}>{chr(39)}) + {len(tag) + 3})')} END"



#: RE2 has no look-behind: a star behind a bold span goes with it, and names are found with the character before them.
_L = r"[^\p{L}\p{N}_]"
_MARKED_SQL, _PROPER_SQL = "|".join([C.MARKED[0] + r"\*?", *C.MARKED[1:]]).replace("'", "''"), C.PROPER.replace("'", "''")


def _keyed(spans: str, limit: int) -> str:
    """Spans (a list of struct s, k) that differ in their key."""
    good = f"list_filter({spans}, lambda x: x.k <> '' AND length(x.k) <= {C.MOST_KEY})"
    return f"array_to_string(list_transform(list_filter({good}, lambda x, i: list_position(list_transform({good}, lambda y: y.k), x.k) = i)[1:{limit}], lambda x: x.s), '|')"


def _with_key(spans: str) -> str:
    return f"list_transform({spans}, lambda s: {{'s': s, 'k': array_to_string(regexp_extract_all(lower(s), '[a-z0-9]+'), ' ')}})"


def _spans(text: str) -> str:
    edges = "' .,:;!?()[]'"
    marked = f"""list_transform(regexp_extract_all({text}, '{_MARKED_SQL}'), lambda s: trim(regexp_replace(s, '^(?:\\*\\*|[*"“''])|(?:\\*+|["”''])$', '', 'g'), {edges}))"""
    proper = f"list_transform(regexp_extract_all({text}, '(?:^|{_L})({_PROPER_SQL})', 1), lambda s: trim(s, {edges}))"
    words = lambda w: ", ".join(f"'{x}'" for x in w)
    named = f"list_filter({_with_key(proper)}, lambda x: length(x.k) >= 3 AND x.k NOT IN ({words(C.GENERIC)}) AND string_split(x.k, ' ')[1] NOT IN ({words(C.LEADING)}))"
    return f"list_concat({_with_key(marked)}, {named})"


def _found(text: str, pattern: str) -> str:
    """Matches between what are no letters; the padding keeps neighbours from sharing a bound."""
    return f"regexp_extract_all(regexp_replace({text}, '({_L})', '\\1\\1', 'g'), '(?i)(?:^|{_L})({pattern})(?:$|{_L})', 1)"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def _narrowed() -> str:
    """One table a group of rules."""
    asked = "list_concat(" + ", ".join(f"CASE WHEN regexp_matches(q, '(?i){p}') THEN {_list(v)} ELSE [] END" for _, p, v in RELATIONS) + ")"
    out = f"p0 AS (SELECT *, {asked} AS p FROM d)"
    for i, (members, choices, every) in enumerate(GROUPS):
        hits = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, '(?i){p}') THEN {_list(v)} END" for p, v in choices) + "], lambda x: x IS NOT NULL)"
        added = "flatten(h)" if every else "h[1]"
        out += f",\np{i + 1} AS (SELECT * REPLACE (CASE WHEN len(h) > 0 AND list_has_any(p, {_list(members)}) THEN list_concat(list_filter(p, lambda x: NOT list_contains({_list(members)}, x)), {added}) ELSE p END AS p) FROM (SELECT * EXCLUDE (h), {hits} AS h FROM (SELECT *, NULL AS h FROM p{i})))"
        out = out.replace(f"(SELECT * EXCLUDE (h), {hits} AS h FROM (SELECT *, NULL AS h FROM p{i}))", f"(SELECT *{' EXCLUDE (h)' if i else ''}, {hits} AS h FROM p{i})")
    return out


QUERIES = {
    "salient_values": (salient_values, f"SELECT lang, kind, count(*) AS n, count(DISTINCT value) AS distinct_values FROM {_values('documents', 'doc_id, lang')} GROUP BY 1, 2"),
    "value_contexts": (value_contexts, rf"""
WITH t AS (SELECT doc_id, max((kind, value)) AS v FROM {_values("documents", "doc_id")} GROUP BY 1),
s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) AS text, generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), 1) AS i FROM documents),
h AS (SELECT s.* FROM s JOIN (SELECT doc_id, i, kind, value FROM {_values("s", "doc_id, i")}) z USING (doc_id, i) JOIN t USING (doc_id) WHERE (z.kind, z.value) = v),
w AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(text), '{T.NUMBER}|[a-z]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '{T.NUMBER}|[a-z]+'), 1) AS j FROM h),
k AS (SELECT doc_id, w, min((i, j)) AS place FROM w WHERE NOT regexp_matches(w, '^[0-9]') AND w NOT IN ({_STOP}) GROUP BY 1, 2),
a AS (SELECT doc_id, count(*)::INT AS words, string_agg(w, ' ' ORDER BY place) AS joined FROM k GROUP BY 1)
SELECT doc_id, v[1] AS kind, v[2] AS value, coalesce(words, 0) AS words, md5(coalesce(joined, '')) AS digest FROM t LEFT JOIN a USING (doc_id)"""),
    "cue_flags": (_docs(lambda t: [T.cue_flag(t, CUES, NEGATIONS).alias("flag"), F.md5(T.redact_cues(t, CUES)).alias("redacted")]), rf"""
WITH {_flags(CUES, NEGATIONS)}
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(flag, false) END AS flag, md5(regexp_replace(text, '(?i)\b(?:{CUES})\b', '[cue]', 'g')) AS redacted FROM documents LEFT JOIN f USING (doc_id)"""),
    "kept_clauses": (_docs(lambda t: [F.md5(T.drop_clauses(t, CLAUSE_CUES, "nothing")).alias("digest")]), rf"""
WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(replace(text, '\n', chr(10)), '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), '([0-9]+\.[\s\x01])', chr(1) || '\1', 'g') AS c FROM documents),
k AS (SELECT doc_id, text, array_to_string(list_filter(list_transform(string_split(c, chr(1)), lambda x: {_TRIM.format('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)\b(?:{CLAUSE_CUES})\b')), ' ') AS k FROM c)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN md5(CASE WHEN k = '' OR k IS NULL THEN 'nothing' ELSE k END) END AS digest FROM k"""),
    "page_parts": (page_parts, f"""
SELECT page_id, md5({_TRIM.format(_behind(_behind('html', '</p>'), '</article>'))}) AS last, md5({_before('head')}) AS head, md5({_after('head')}) AS body, md5({_before('nav')}) AS before_nav, md5({_after('nav')}) AS after_nav, NULL AS thought FROM pages"""),
    "text_features": (lambda s, d: rounded(read(s, d, "documents").select("doc_id", *T.text_features(F.col("text")))), rf"""
SELECT doc_id, round(ln(1 + length(text)), 6) AS log_chars, round(ln(1 + len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+'))), 6) AS log_words, {_counts()} FROM documents"""),
    "role_shapes": (role_shapes, f"""
WITH c AS (SELECT conv_id, string_agg(coalesce(role, ''), '>' ORDER BY turn, role) AS shape, coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS chars FROM conversations GROUP BY 1)
SELECT conv_id, shape FROM c WHERE chars <= {MOST_CHARS} AND shape IN ({', '.join(f"'{'>'.join(r)}'" for r in SHAPES)})"""),
    "final_reasonings": (final_reasonings, """
WITH t AS (SELECT conv_id, role, turn, CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10))[1] ELSE '' END AS r FROM conversations),
m AS (SELECT conv_id, max((turn, coalesce(r, ''))) FILTER (role = 'assistant') AS m FROM t GROUP BY 1) SELECT conv_id, md5(coalesce(m[2], '')) AS digest FROM m"""),
    "claims": (claims, f"""
WITH d AS (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS q, array_to_string(string_split(regexp_replace(CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:3], ' ') AS a FROM documents),
{_narrowed()}
SELECT doc_id, {_keyed(_spans("q"), 12)} AS subjects, {_keyed(_spans("coalesce(a, '')"), 6)} AS values,
{_keyed(_with_key("list_concat(" + _found("q || ' ' || coalesce(a, '')", C.YEAR) + ", " + _found("q || ' ' || coalesce(a, '')", "|".join(C.QUALIFYING)) + ")"), 8)} AS qualifiers,
array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(q, '(?i){p}') THEN '{n}' END" for n, p, _ in RELATIONS)}], lambda x: x IS NOT NULL), '|') AS relations,
array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), '|') AS predicates FROM p{len(GROUPS)}"""),
    "text_views": (text_views, """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations WHERE role IN ('system', 'user', 'assistant')), l AS (SELECT conv_id, max((turn, t)) FILTER (role = 'assistant') AS l FROM t GROUP BY 1),
c AS (SELECT conv_id, string_agg(upper(role) || ': ' || t, chr(10) || chr(10) ORDER BY turn, upper(role) || ': ' || t) AS c FROM t JOIN l USING (conv_id) WHERE role <> 'assistant' AND (l IS NULL OR turn < l[1]) GROUP BY 1),
v AS (SELECT conv_id, coalesce(l[2], '') AS o, coalesce(CASE WHEN length(c) <= 300 THEN c ELSE '... ' || right(c, 300) END, '') AS c FROM l LEFT JOIN c USING (conv_id))
SELECT conv_id, md5(o) AS output, md5(c) AS context, md5(concat_ws(chr(10) || chr(10), nullif(c, ''), nullif(o, ''))) AS both FROM v"""),
    "reused_parsed": (reused_parsed, """
WITH d AS (SELECT doc_id, text, coalesce(source, 'src1') = 'src1' AND doc_id % 2 = 0 AS e, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS c FROM documents)
SELECT doc_id, CASE WHEN e THEN 2 WHEN c THEN 1 ELSE 0 END AS reused, CASE WHEN e THEN -2 WHEN c THEN -1 ELSE length(text) END::INT AS size FROM d"""),
}
