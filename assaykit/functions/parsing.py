"""Names, tags, JSON in text, hashed features, overlaps, facts and consistency rules as columns."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import ratio

#: Words that turn a statement round.
NEGATIONS = "not|never|no|without"

_DECODER = json.JSONDecoder()


def parse_dataset_name(name: Column, splits: list[str], bases: list[str]) -> Column:
    """``split, task, model_id, lora_id`` of ``org/<split>-<task>-<base>[-<lora>]``: the longest split, the earliest base.

    A name without a known split has none; without a known base all of the rest is the task. ``none`` and an empty tail are no lora.
    """
    rest = F.regexp_replace(name, "^[^/]*/", "")
    split = F.regexp_extract(rest, "^(" + "|".join(sorted(splits, key=len, reverse=True)) + ")-", 1)
    tail = F.when(split != "", F.substring(rest, F.length(split) + 2, F.length(rest))).otherwise(rest)
    pattern = "^(.*?)-(" + "|".join(bases) + ")(?:-(.*))?$"
    part = lambda i: F.regexp_extract(tail, pattern, i)
    return F.struct(F.nullif(split, F.lit("")).alias("split"), F.when(part(2) != "", part(1)).otherwise(tail).alias("task"), F.nullif(part(2), F.lit("")).alias("model_id"), F.nullif(F.nullif(part(3), F.lit("")), F.lit("none")).alias("lora_id"))


def codename(key: Column, names: list[str]) -> Column:
    """The name at SHA-256(key) modulo their number; the hash is reduced eight hex digits at a time."""
    n, digest = len(names), F.sha2(key, 256)
    place = F.lit(0).cast("long")
    for k in range(8):
        place = (place * (2**32 % n) + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")) % n
    return F.element_at(F.array(*[F.lit(x) for x in names]), (place + 1).cast("int"))


def redact_names(text: Column, mapping: dict[str, str]) -> Column:
    """Real names replaced, the longest first."""
    for name in sorted(mapping, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(name), F.lit(mapping[name]))
    return text


def normalize_tag(tag: Column) -> Column:
    """white or black, whatever the case, dashes, underscores and spaces, with or without box; else NULL."""
    plain = F.regexp_replace(F.translate(F.lower(tag), "-_ ", ""), "box$", "")
    return F.when(plain.isin("white", "black"), plain)


def object_at(text: str) -> str | None:
    """The first part of a text that is a JSON object.

    Each opening brace is tried by the decoder, which knows strings, escapes and inner brackets and stops at the first fault.
    """
    at = text.find("{")
    while at >= 0:
        try:
            value, end = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
            continue
        return text[at:end] if isinstance(value, dict) else None
    return None


def _first_objects(text: pa.Array) -> pa.Array:
    return pa.array([object_at(t) if t and "{" in t else None for t in text.to_pylist()], pa.string())


def first_object(text: Column | str) -> Column:
    """The first JSON object of each text, as it stands there, found in Arrow batches; NULL where there is none."""
    return F.arrow_udf(_first_objects, "string")(text)


def parse_json_enum(text: Column, allowed: dict[str, list[str]], filled: list[str]) -> Column:
    """``value`` (the first object that is JSON, inner objects included) and ``errors``: enumerated fields off their values, empty texts.

    Without an object the value is NULL and every field is an error.
    """
    value = first_object(text)
    field = lambda k: F.get_json_object(value, f"$.{k}")
    bad = [F.when(~F.coalesce(field(k).isin(v), F.lit(False)), F.lit(k)) for k, v in allowed.items()] + [F.when(F.coalesce(F.trim(field(k)), F.lit("")) == "", F.lit(k)) for k in filled]
    return F.struct(value.alias("value"), F.array_compact(F.array(*bad)).alias("errors"))


def hash_features(df: DataFrame, key: str, features: Column, bits: int = 13) -> DataFrame:
    """``key, slot, value``: features (array of name, value) added up in the slot of their name's CRC-32."""
    rows = df.select(key, F.explode(features).alias("f"))
    return rows.groupBy(key, F.crc32(F.col("f.name").cast("binary")).bitwiseAND(2**bits - 1).cast("int").alias("slot")).agg(F.sum("f.value").alias("value"))


def terms(text: Column, least: int = 4) -> Column:
    """The distinct terms of a least length."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))


def share(part: Column, whole: Column) -> Column:
    """The share of ``whole`` that ``part`` holds, 0 where it is empty."""
    return F.size(F.array_intersect(whole, part)) / F.greatest(F.lit(1), F.size(whole))


def number_recall(query: Column, passage: Column) -> Column:
    """Share of the query's numbers in the passage; 1 where the query has none."""
    return F.when(F.size(numbers(query)) == 0, 1.0).otherwise(share(numbers(passage), numbers(query)))


def lexical_relevance(query: Column, passage: Column) -> Column:
    """Share of the query's terms in the passage, and half a point where they share a number."""
    return share(terms(passage), terms(query)) + F.when(F.size(F.array_intersect(numbers(query), numbers(passage))) > 0, 0.5).otherwise(0.0)


def title_overlap(query: Column, title: Column) -> Column:
    """Share of the title's terms in the query."""
    return share(terms(query), terms(title))


def length_similarity(a: Column, b: Column) -> Column:
    """The shorter length over the longer, 1 for two empty texts."""
    return F.coalesce(ratio(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))), F.when(F.length(a) == F.length(b), 1.0))


def reciprocal_rank(rank: Column) -> Column:
    return 1 / (2 + rank)


def token_recall(conversation: Column, target: Column, evidence: Column) -> Column:
    """``novel`` (share of the target's terms that are new to the conversation which the evidence has), ``recall`` and ``precision``."""
    t, e = terms(target), terms(evidence)
    return F.struct(share(e, F.array_except(t, terms(conversation))).alias("novel"), share(e, t).alias("recall"), share(t, e).alias("precision"))


def negated(text: Column) -> Column:
    return F.lower(text).rlike(rf"(^|[^a-z])({NEGATIONS})([^a-z]|$)")


def verdict_conflict(statement: Column, answer: Column, least: float = 0.9) -> Column:
    """Whether an answer that begins with false restates the statement with its polarity, or one that begins with true with the other."""
    verdict = F.regexp_extract(F.lower(F.trim(answer)), "^(true|false)([^a-z]|$)", 1)
    rest = F.regexp_replace(F.lower(F.trim(answer)), "^(true|false)[^a-z]*", "")
    plain = lambda t: F.filter(terms(t), lambda w: ~w.isin(NEGATIONS.split("|")))
    same = lambda c: (F.size(plain(statement)) > 0) & (share(plain(c), plain(statement)) >= least)
    clauses = F.split(rest, "[.;]")
    restated = F.exists(clauses, lambda c: same(c) & (negated(c) == negated(statement)))
    turned = F.exists(clauses, lambda c: same(c) & (negated(c) != negated(statement)))
    return F.when(verdict == "false", restated).when(verdict == "true", turned).otherwise(F.lit(False))


def value_disagreement(output: Column, reply: Column, states: list[str]) -> Column:
    """Whether both texts name exactly one of the states, and not the same."""
    found = lambda t: F.filter(F.array(*[F.lit(s) for s in states]), lambda s: F.exists(F.split(F.lower(t), "[^a-z]+"), lambda w: w == s))
    a, b = found(output), found(reply)
    return (F.size(a) == 1) & (F.size(b) == 1) & (F.element_at(a, 1) != F.element_at(b, 1)) if len(states) else F.lit(False)


def repeats_question_value(question: Column, passage: Column) -> Column:
    """Whether a passage has numbers, and all of them stand in the question."""
    return (F.size(numbers(passage)) > 0) & (F.size(F.array_except(numbers(passage), numbers(question))) == 0)


def parse_fact(text: Column) -> Column:
    """``predicate, value, qualifiers, years, decade`` of ``predicate: value [qualifiers]``; a text without a colon has only a value."""
    qualifiers = F.regexp_extract(text, r"\[([^\]]*)\]\s*$", 1)
    body = F.trim(F.regexp_replace(text, r"\s*\[[^\]]*\]\s*$", ""))
    has = body.contains(": ")
    value = F.when(has, F.substring(body, F.locate(": ", body) + 2, F.length(body))).otherwise(body)
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])(1[5-9][0-9]{2}|20[0-9]{2}|21[0-9]{2}|2200)(?:[^0-9]|$)"), F.lit(1)))
    first = F.try_element_at(years, F.lit(1)).cast("int")
    return F.struct(F.when(has, F.substring_index(body, ": ", 1)).alias("predicate"), F.trim(value).alias("value"), F.filter(F.split(qualifiers, "; "), lambda q: q != "").alias("qualifiers"), years.alias("years"), (F.floor(first / 10) * 10).cast("int").alias("decade"))


def margin(logs: Column, positive: str, negative: str) -> Column:
    """Positive minus negative entry of a map of log probabilities; NULL where one lacks."""
    return F.try_element_at(logs, F.lit(positive)) - F.try_element_at(logs, F.lit(negative))


def binary_softmax(logs: Column, positive: str, negative: str) -> Column:
    return 1 / (1 + F.exp(-margin(logs, positive, negative)))


def normalize_messages(raw: Column) -> Column:
    """``array<role, content, reasoning>`` of a JSON array, one JSON object, a bare text (a user's) or NULL (no messages)."""
    kind = "struct<role:string,content:string,reasoning:string>"
    many, one = F.from_json(raw, f"array<{kind}>"), F.from_json(raw, kind)
    filled = lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"), m["reasoning"].alias("reasoning"))
    bare = F.struct(F.lit("user").alias("role"), raw.alias("content"), F.lit(None).cast("string").alias("reasoning"))
    start = F.ltrim(raw)
    return F.when(raw.isNull(), F.array().cast(f"array<{kind}>")).when(start.startswith("["), F.transform(many, filled)).when(start.startswith("{"), F.array(filled(one))).otherwise(F.array(bare))


def final_exchange(dialogue: Column) -> Column:
    """``question, answer``: the last user and assistant blocks of a ``SYSTEM:/USER:/ASSISTANT:`` transcript; NULL where there is none."""
    block = lambda role: F.try_element_at(F.regexp_extract_all(dialogue, F.lit(rf"(?s)(?:^|\n\n){role}: (.*?)(?=\n\n(?:SYSTEM|USER|ASSISTANT): |$(?![\s\S]))"), F.lit(1)), F.lit(-1))
    return F.struct(block("USER").alias("question"), block("ASSISTANT").alias("answer"))


def extract_spans(text: Column, limit: int = 8) -> Column:
    """Marked spans (bold, quoted), then capitalised pairs and years, the first of those equal but for case, at most ``limit``."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    spans = F.concat(found(r"\*\*([^*]+)\*\*"), found('"([^"]{2,80})"'), found(r"([A-Z][a-z]+ [A-Z][a-z]+)"), found(r"(1[5-9][0-9]{2}|20[0-9]{2})"))
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, s: Column) -> Column:
        more = F.struct(F.array_append(state["keys"], F.lower(F.trim(s))).alias("keys"), F.array_append(state["spans"], F.trim(s)).alias("spans"))
        return F.when((F.size(state["keys"]) >= limit) | F.array_contains(state["keys"], F.lower(F.trim(s))), state).otherwise(more)

    # A fold looks at each span once; a filter that asks for its first place would cut the text anew for each.
    return F.aggregate(spans, start, step, lambda state: state["spans"])


def relation_names(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The relations whose pattern occurs, in the order of the table."""
    return F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(name)) for name, p in patterns]))
