"""What a question and its answer claim: the things they name, qualifiers, and the relations asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that link parts of a name, that begin a question and no name, and names that name nothing in particular.
LINKING = ["of", "in", "the", "de", "del", "della", "van", "von", "and"]
LEADING = ["according", "before", "in", "name", "on", "prior", "published", "that", "these", "this", "what", "when", "where", "which", "who"]
GENERIC = ["assistant", "system", "user", "england", "english", "united states", "which", "what", "where", "when", "who", "the", "a", "an"]
#: Words that restrict a claim.
QUALIFYING = ["first", "last", "only", "without", "before", "after", "between", "longest", "shortest", "highest", "lowest", "largest", "smallest", "most", "least", "never", "not"]

_LETTER, _EDGES = r"[\p{L}\p{N}_]", " .,:;!?()[]"
_NAME = r"[A-Z][\p{L}\p{N}_’'-]*"
#: Fixed values, the patterns of spans and years. A name: up to seven capitalised words, linking words between them.
PROPER = rf"{_NAME}(?:\s+(?:{_NAME}|(?:(?:{'|'.join(LINKING)})\s+)+{_NAME})){{0,6}}"
#: Bold, italic, quoted in two ways.
MARKED = [r"\*\*[^*]{2,120}\*\*", r"\*[^*]{2,120}\*", '["“][^"”]{2,120}["”]', r"'[^'\n]{3,120}'"]
YEAR = "(?:1[0-9]{3}|20[0-9]{2})"
MOST_KEY = 120


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def span_key(span: Column) -> Column:
    """Words in lower case, single spaces between them."""
    return F.array_join(_all(F.lower(span), "[a-z0-9]+"), " ")


def marked_spans(text: Column) -> Column:
    """Bold, italic and quoted spans in order, without their marks and outer punctuation."""
    bold, italic, double, single = MARKED
    found = _all(text, rf"{bold}|(?<!\*){italic}(?!\*)|{double}|(?<!{_LETTER}){single}(?!{_LETTER})")
    return F.transform(found, lambda s: F.btrim(F.regexp_replace(s, r"""^(?:\*\*|[*"“'])|(?:\*\*|[*"”'])$""", ""), F.lit(_EDGES)))


def proper_spans(text: Column) -> Column:
    """Capitalised names in order, without those that begin with a word of questions, say nothing in particular, or have under three letters."""
    found = F.transform(_all(text, f"(?<!{_LETTER}){PROPER}"), lambda s: F.btrim(s, F.lit(_EDGES)))
    keyed = F.transform(found, lambda s: F.struct(s.alias("s"), span_key(s).alias("k")))
    kept = F.filter(keyed, lambda x: (F.length(x["k"]) >= 3) & ~x["k"].isin(*GENERIC) & ~F.substring_index(x["k"], " ", 1).isin(*LEADING))
    return F.transform(kept, lambda x: x["s"])


def unique_spans(spans: Column, limit: int = 12) -> Column:
    """The first ``limit`` spans that differ in their key; empty keys and those of over 120 characters are skipped."""
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        new = (F.size(state["keys"]) < limit) & ~F.array_contains(state["keys"], x["k"])
        more = F.struct(F.array_append(state["keys"], x["k"]).alias("keys"), F.array_append(state["spans"], x["s"]).alias("spans"))
        return F.when(new, more).otherwise(state)

    keyed = F.filter(F.transform(spans, lambda s: F.struct(s.alias("s"), span_key(s).alias("k"))), lambda x: (x["k"] != "") & (F.length(x["k"]) <= MOST_KEY))
    return F.aggregate(keyed, start, step, lambda state: state["spans"])


def qualifiers(text: Column, limit: int = 8) -> Column:
    """Years, then restricting words, each once, at most ``limit``."""
    bounded = lambda p: f"(?<!{_LETTER})(?:{p})(?!{_LETTER})"
    return unique_spans(F.concat(_all(text, bounded(YEAR)), _all(text, "(?i)" + bounded("|".join(QUALIFYING)))), limit)


def narrow(predicates: Column, question: Column, groups: list[tuple[list[str], list[tuple[str, list[str]]], bool]]) -> Column:
    """Predicates narrowed by rule groups ``(members, choices (pattern, predicates), every)``, each after the other.

    If a predicate is a member of a group and a choice's pattern occurs in the question, the members give way to the predicates of the
    first such choice, or of every one. A group none of whose patterns occurs leaves all as they are.
    """
    array = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")

    def step(known: Column, members: list[str], hits: Column, every: bool) -> Column:
        added = F.flatten(hits if every else F.slice(hits, 1, 1))
        applies = F.arrays_overlap(known, array(members)) & (F.size(hits) > 0)
        return F.when(applies, F.concat(F.filter(known, lambda v: ~v.isin(*members)), added)).otherwise(known)

    for members, choices, every in groups:
        hits = F.array_compact(F.array(*[F.when(question.rlike(f"(?i){p}"), array(v)) for p, v in choices]))
        # The one element of an array is a name for what would be written out three times a group.
        predicates = F.transform(F.array(predicates), lambda x: step(x, members, hits, every))[0]
    return F.array_distinct(predicates)


def extract_claim(question: Column, answer: Column, relations: list[tuple[str, str, list[str]]], groups: list, sentences: int = 3) -> Column:
    """``subjects, values, qualifiers, relations, predicates`` of a question and the first sentences of its answer; NULL counts as empty.

    ``relations (name, pattern, predicates)``: those whose pattern occurs in the question; their predicates are narrowed by ``groups``.
    """
    question, answer = (F.coalesce(c, F.lit("")) for c in (question, answer))
    head = F.array_join(F.slice(F.split(answer, r"(?<=[.!?])\s+"), 1, sentences), " ")
    named = F.array_compact(F.array(*[F.when(question.rlike(f"(?i){p}"), F.lit(n)) for n, p, _ in relations]))
    asked = F.flatten(F.array_compact(F.array(*[F.when(question.rlike(f"(?i){p}"), F.array(*[F.lit(x) for x in v])) for _, p, v in relations])))
    return F.struct(
        unique_spans(F.concat(marked_spans(question), proper_spans(question))).alias("subjects"), unique_spans(F.concat(marked_spans(head), proper_spans(head)), 6).alias("values"),
        qualifiers(F.concat_ws(" ", question, head)).alias("qualifiers"), named.alias("relations"), narrow(asked, question, groups).alias("predicates"),
    )
