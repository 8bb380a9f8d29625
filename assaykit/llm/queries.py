"""One query per operator, over whole tables with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, mixing, ngram_join, phrase_automata, pieces, prefix_trie, quality, sharding, suffix_dedup
from . import token_counts, topk_search, toxicity, whitening
from .textio import cut

PIECE_MODEL = "piece_bpe_32k.model"


def model_path(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), links=True)


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_shards(read(spark, sf_dir, "documents"), 8)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


def op3_line_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.line_likeness(read(spark, sf_dir, "documents"))


def op4_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.score_quality(docs, quality.fit_quality(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op5_toxicity_convolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k_search(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row; ``shard_words`` holds the words of each output shard, as the splitting tree deals them."""
    rows = cut(mixing.measured(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "__h"))
    out = mixing.take_words(rows, rows, n_shards=8)
    words = lambda take: F.aggregate(take, F.lit(0).cast("long"), lambda n, t: n + t["words"])
    in_shard = lambda k: F.filter("takes", lambda t: t["shard"] == k)
    shards = F.array(*[words(in_shard(k)) for k in range(8)])
    return out.select("doc_id", "size", "source_size", "target", words(F.col("takes")).alias("taken"), shards.alias("shard_words"))


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of strings of 400 bytes; ``n_passages`` and ``passage_bytes`` report repeated passages of over 50 words, also shorter ones."""
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), passages=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_bytes")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again: token count, a hash of the ids, parity of the libraries, round trip."""
    coded = pieces.encode_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), model_path(), decoded=True)
    return coded.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", F.xxhash64("ids").alias("ids_hash"), "parity", "round_trip")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), model_path(), limit=4096)


def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), k=32)


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_automata.remove_repeated_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(prefix_trie.rebuilt_paths(read(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_external_shuffle": op2_external_shuffle,
        "op3_multiset_fingerprints": op3_multiset_fingerprints,
        "op3_line_likeness": op3_line_likeness,
        "op4_quality_trees": op4_quality_trees,
        "op5_toxicity_convolution": op5_toxicity_convolution,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_source_mix": op7_source_mix,
        "op8_repeated_strings": op8_repeated_strings,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_token_counts": op10_token_counts,
        "op11_qdwh_whitening": op11_qdwh_whitening,
        "op12_phrase_automata": op12_phrase_automata,
        "op13_prefix_trie": op13_prefix_trie,
    }


_LANES = ", ".join(f"sum(('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT) % 4294967296" for k in range(fingerprints.DENSE))
_SPARSE = ", ".join(f"coalesce(sum(v) FILTER (k = {k}), 0) % 65536" for k in range(fingerprints.SPARSE))
_HEX = "array_to_string(list_transform({0}, lambda x: lpad(lower(to_hex(x)), 8, '0')), '')"
_SAME = f"list_sum(list_transform(range({fingerprints.DENSE + 2}, {fingerprints.DENSE + fingerprints.SPARSE + 2}), lambda i: ({{0}}[i] = {{1}}[i])::INT))"
_LIKE = f"CASE WHEN {{0}}[1:{fingerprints.DENSE + 1}] = {{1}}[1:{fingerprints.DENSE + 1}] THEN 1.0 ELSE greatest(0.0, 1.0 - (-{fingerprints.SPARSE}.0 * ln(greatest({_SAME}::DOUBLE, 0.5) / {fingerprints.SPARSE})) / ({{0}}[1] + {{1}}[1])) END"

_OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER w, first_value(text) OVER w, '') AS nx, length(coalesce(text, ''))::BIGINT AS n
           FROM documents WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(t, 1, n - n // 4) || substr(nx, 1, n // 4) AS ed FROM d),
texts AS (SELECT doc_id, 1 AS w, t AS x FROM e UNION ALL SELECT doc_id, 2, ed FROM e UNION ALL SELECT doc_id, 3, nx FROM e),
lines AS (SELECT doc_id, w, unnest(string_split(x, chr(10))) AS p FROM texts),
hashed AS (SELECT doc_id, w, sha256('a' || p) || sha256('b' || p) AS h FROM lines WHERE p <> ''),
parts AS (SELECT *, ('0x' || h[1:8])::BIGINT % {fingerprints.SPARSE} AS k, ('0x' || h[9:12])::BIGINT | 1 AS v FROM hashed),
vec AS (SELECT doc_id, w, list_concat([count(*)], list_concat([{_LANES}], [{_SPARSE}]))::BIGINT[] AS z FROM parts GROUP BY doc_id, w),
v0 AS (SELECT texts.doc_id, texts.w, coalesce(z, list_transform(range(0, {fingerprints.DENSE + fingerprints.SPARSE + 1}), lambda i: 0)) AS z FROM texts LEFT JOIN vec ON vec.doc_id = texts.doc_id AND vec.w = texts.w),
j AS (SELECT e.doc_id, n, sha256(ed) AS s, a.z AS a, b.z AS b, c.z AS c FROM e JOIN v0 a ON a.doc_id = e.doc_id AND a.w = 1 JOIN v0 b ON b.doc_id = e.doc_id AND b.w = 2 JOIN v0 c ON c.doc_id = e.doc_id AND c.w = 3)
SELECT doc_id, n AS n_chars, s AS edited_sha256, {_HEX.format("a")} AS fingerprint, {_HEX.format("b")} AS edited_fingerprint, {_LIKE.format("a", "b")} AS near_edited, {_LIKE.format("a", "c")} AS near_next FROM j
"""

_LEVEL_LIKE = "CASE WHEN z1 = {0} THEN 1.0 ELSE greatest(0.0, 1.0 - greatest(coalesce({1}, (n1 + {2})::DOUBLE), abs(n1 - {2})::DOUBLE) / (n1 + {2})) END"
_LEVEL_DIFFER = f"coalesce(arg_min(-{float(fingerprints.LANES)} * {fingerprints.STEP} ** l * ln({{0}}::DOUBLE / {fingerprints.LANES}), l) FILTER ({{0}} >= {fingerprints.LEAST_EQUAL}), max(-{float(fingerprints.LANES)} * {fingerprints.STEP} ** l * ln(nullif({{0}}, 0)::DOUBLE / {fingerprints.LANES})) FILTER (l = {fingerprints.LEVELS - 1} AND {{0}} > 0))"
_OP3_LIKENESS = f"""
{_OP3[: _OP3.index("parts AS")]}
parts AS (SELECT *, ('0x' || h[1:8])::BIGINT % {fingerprints.LANES} AS k, ('0x' || h[9:12])::BIGINT | 1 AS v, ('0x' || h[17:24])::BIGINT AS s FROM hashed),
vec AS (SELECT doc_id, w, count(*) AS n, list_concat([count(*)], [{_LANES}])::BIGINT[] AS z FROM parts GROUP BY doc_id, w),
lanes AS (SELECT doc_id, w, l, k, sum(v) % 65536 AS z FROM parts, (SELECT unnest(range(0, {fingerprints.LEVELS}))::INT AS l) WHERE s % ({fingerprints.STEP} ** l)::BIGINT = 0 GROUP BY doc_id, w, l, k),
wide AS (SELECT doc_id, l, k, coalesce(max(z) FILTER (w = 1), 0) AS a, coalesce(max(z) FILTER (w = 2), 0) AS b, coalesce(max(z) FILTER (w = 3), 0) AS c FROM lanes GROUP BY doc_id, l, k),
same AS (SELECT doc_id, l, {fingerprints.LANES} - count(*) FILTER (a <> b) AS sb, {fingerprints.LANES} - count(*) FILTER (a <> c) AS sc FROM wide GROUP BY doc_id, l),
full_same AS (SELECT e.doc_id, g.l, coalesce(sb, {fingerprints.LANES}) AS sb, coalesce(sc, {fingerprints.LANES}) AS sc FROM e CROSS JOIN (SELECT unnest(range(0, {fingerprints.LEVELS}))::INT AS l) g LEFT JOIN same ON same.doc_id = e.doc_id AND same.l = g.l),
differ AS (SELECT doc_id, {_LEVEL_DIFFER.format("sb")} AS db, {_LEVEL_DIFFER.format("sc")} AS dc FROM full_same GROUP BY doc_id),
j AS (SELECT e.doc_id, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2, coalesce(c.n, 0) AS n3, coalesce(a.z, []) AS z1, coalesce(b.z, []) AS z2, coalesce(c.z, []) AS z3, db, dc FROM e JOIN differ USING (doc_id)
      LEFT JOIN vec a ON a.doc_id = e.doc_id AND a.w = 1 LEFT JOIN vec b ON b.doc_id = e.doc_id AND b.w = 2 LEFT JOIN vec c ON c.doc_id = e.doc_id AND c.w = 3)
SELECT doc_id, n1 AS n_lines, {_LEVEL_LIKE.format("z2", "db", "n2")} AS near_edited, {_LEVEL_LIKE.format("z3", "dc", "n3")} AS near_next FROM j
"""

_OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, len(w) + 1)) AS i, len(w) AS n, w FROM d),
k AS (SELECT r, doc_id, i, w[i] AS word, CASE WHEN i + 19 <= n THEN md5(array_to_string(w[i:i + 19], ' ')) END AS k FROM p),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY k) < doc_id OR row_number() OVER (PARTITION BY r, k ORDER BY i) > 1 AS earlier FROM k),
c AS (SELECT r, i, word, max((k IS NOT NULL AND earlier)::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
g AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS m, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(m, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (r)
"""

_CRC_TABLE = "list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(tab[(xor(c, b) % 256) + 1], c >> 8)))"
_OP13 = f"""
WITH own AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
z AS (SELECT {_CRC_TABLE} AS tab), h AS (SELECT c, t, ({_CRC.format("c")} % 9)::INT AS h FROM own, z),
built AS (SELECT h.c, list_concat(coalesce(b.t[1:h], []), h.t[h + 1:]) AS t FROM h LEFT JOIN own b ON b.c = h.c - h.c % 5),
mem AS (SELECT c, d, len(t) = d AS whole, md5(to_json(t[1:d])) AS k, CASE WHEN d > 0 THEN md5(to_json(t[1:d - 1])) END AS up, coalesce(strlen(t[d].t), 0) AS b FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM built)),
node AS (SELECT k, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n, any_value(b) AS b, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (whole), '')) AS ends FROM mem GROUP BY k),
kids AS (SELECT up AS k, count(*) AS m FROM node WHERE up IS NOT NULL GROUP BY 1),
sub AS (SELECT DISTINCT a.k, x.k AS below FROM mem a JOIN mem x ON a.c = x.c AND a.d <= x.d),
tot AS (SELECT sub.k, count(*) FILTER (kids.k IS NULL) AS leaves, sum((n - 1) * b)::BIGINT AS saved FROM sub JOIN node ON node.k = below LEFT JOIN kids ON kids.k = below GROUP BY 1)
SELECT node.conv_id, node.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.m, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, node.ends AS ends_sha256
FROM node LEFT JOIN node p ON p.k = node.up LEFT JOIN kids ON kids.k = node.k JOIN tot ON tot.k = node.k
"""


def oracle_sql() -> dict:
    return {"op3_multiset_fingerprints": _OP3, "op3_line_likeness": _OP3_LIKENESS, "op6_exact_top_k": _OP6, "op12_phrase_automata": _OP12, "op13_prefix_trie": _OP13}
