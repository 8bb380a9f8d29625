"""Text functions as columns: truncation, terms, sentences, numbers, cues, tags and shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word bounds are those of ASCII words on every Java version.
_BEGIN, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def truncate_text(text: Column, n: int, mode: str = "head", marker: str = " ... ") -> Column:
    """At most n characters beside the marker: ``head``, ``tail``, or both ends: ``head_tail`` in halves, ``quarter`` or ``third`` at the head,
    ``three_quarters`` at the head. A text that fits stays; NULL stays NULL."""
    head = {"head": n, "tail": 0, "head_tail": n // 2, "quarter": n // 4, "three_quarters": n - n // 4, "third": n // 3}[mode]
    parts = ([F.left(text, F.lit(head))] if head else []) + [F.lit(marker)] + ([F.right(text, F.lit(n - head))] if n - head else [])
    return F.when(F.length(text) <= n, text).otherwise(F.concat(*parts))


def normalize_name(text: Column) -> Column:
    """Lower case, single spaces, ``st `` written out, no leading article."""
    squeezed = F.trim(F.regexp_replace(F.lower(text), "[ \t\n\r\f]+", " "))
    return F.regexp_replace(F.regexp_replace(squeezed, "(^| )st ", "$1saint "), "^the ", "")


#: Frequent words that say nothing about a text.
STOP_WORDS = "a about after all also an and any are as at be been but by can could did do does for from had has have he her his how if in into is it its more most no not of on one or other our out over she so some such than that the their them then there these they this to up was we were what when where which who will with would you".split()


def key_terms(text: Column, least: int = 3, limit: int = 12, stop: list[str] | None = None) -> Column:
    """As ``content_terms`` without stop words."""
    words = STOP_WORDS if stop is None else stop
    kept = F.filter(_all(F.lower(text), "[a-z0-9]+"), lambda t: (F.length(t) >= least) & ~t.isin(*words))
    return F.slice(F.array_distinct(kept), 1, limit)


#: Character references of HTML that texts hold most often.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """Named references as characters, ``&amp;`` last; the replacement character and control characters but line ends and tabs are dropped."""
    for name, character in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(character))
    return F.regexp_replace(text, "[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uFFFD]", "")


def repaired(body: Column) -> Column:
    """A text of bytes; those that are no UTF-8 become the replacement character."""
    return F.make_valid_utf8(body.cast("string"))


def prose_sentences(text: Column, least: int = 20) -> Column:
    """As ``split_sentences`` without section headings: lines between equals signs, or that begin with a hash."""
    return split_sentences(F.regexp_replace(F.regexp_replace(text, r"(?m)^=+[^=\n]*=+ *$", ""), r"(?m)^#+ .*$", ""), least)


def last_field(text: Column, name: str) -> Column:
    """What stands behind the last ``Name:`` at the begin of a line, to the line's end; NULL where there is none."""
    return F.trim(F.try_element_at(_all(text, rf"(?im)^[ \t]*{name}[ \t]*:[ \t]*(.*)$", 1), F.lit(-1)))


def content_terms(text: Column, least: int = 4, limit: int = 12) -> Column:
    """The first distinct terms of a least length, in order."""
    return F.slice(F.array_distinct(F.filter(_all(F.lower(text), "[a-z0-9]+"), lambda t: F.length(t) >= least)), 1, limit)


def split_sentences(text: Column, least: int = 20) -> Column:
    """Runs up to sentence ends or line ends, trimmed, of a least length."""
    parts = F.transform(_all(text, r"[^.!?\n]+[.!?]*"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


#: Number words of English and the number each stands for, which is its place.
CARDINALS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
]
ORDINALS = [
    "zeroth", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
    "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
]
NUMBER = "[0-9]+(?:[.,][0-9]+)*(?:st|nd|rd|th)?%?"


def number_kind(value: Column) -> Column:
    """percent, ordinal, year (leading digits are four, 1500 to 2200) or cardinal, of a number in lower case without commas."""
    year = value.rlike("^(1[5-9][0-9]{2}|2[01][0-9]{2}|2200)([^0-9]|$)")
    return F.when(value.endswith("%"), "percent").when(value.rlike("^[0-9]+(st|nd|rd|th)$"), "ordinal").when(year, "year").otherwise("cardinal")


def _written_number(value: Column) -> Column:
    kind = number_kind(value)
    whole = F.regexp_extract(value, "^[0-9]+", 0)
    return F.struct(kind.alias("kind"), F.when(kind.isin("ordinal", "cardinal"), whole).otherwise(value).alias("value"))


def _spelled_number(word: Column) -> Column:
    place = lambda words: (F.array_position(F.array(*[F.lit(w) for w in words]), word) - 1).cast("string")
    cardinal = word.isin(*CARDINALS)
    return F.struct(F.when(cardinal, "cardinal").otherwise("ordinal").alias("kind"), F.when(cardinal, place(CARDINALS)).otherwise(place(ORDINALS)).alias("value"))


def salient_values(text: Column) -> Column:
    """The distinct numbers of a text as (kind, value), those in digits first, then number words from zero to twenty and their ordinals.

    Thousands commas go; of an ordinal or cardinal only the leading digits stay, so ``3rd`` and ``third`` are equal. Digits behind a letter
    are no number. NULL stays NULL, a text without numbers gives an empty array.
    """
    lower = F.lower(text)
    written = F.transform(_all(lower, f"(?<![a-z0-9]){NUMBER}"), lambda v: _written_number(F.replace(v, F.lit(","), F.lit(""))))
    spelled = F.transform(_all(lower, f"(?<![a-z])(?:{'|'.join(CARDINALS + ORDINALS)})(?![a-z])"), _spelled_number)
    return F.array_distinct(F.concat(written, spelled))


def value_context(text: Column, kind: Column, value: Column) -> Column:
    """The distinct words, in order, of the sentences that hold a salient value, without stop words and without numbers."""
    holding = F.filter(split_sentences(text, 1), lambda s: F.exists(salient_values(s), lambda v: (v["kind"] == kind) & (v["value"] == value)))
    words = F.flatten(F.transform(holding, lambda s: _all(F.lower(s), f"{NUMBER}|[a-z]+")))
    return F.array_distinct(F.filter(words, lambda w: ~w.rlike("^[0-9]") & ~w.isin(*STOP_WORDS, *CARDINALS, *ORDINALS)))


_SPACE = " \t\n\r\f\x0B"


def cue_flag(text: Column, cues: str, negations: str = "not|never|no", between: int = 5, reach: int = 80) -> Column:
    """Whether a cue occurs that no negation precedes: the ``reach`` characters before it end in a negation and at most ``between`` words.

    One pass over the pieces between the cues, which carries the last characters along.
    """
    cue = f"(?i){_BEGIN}(?:{cues}){_END}"
    negated = rf"(?i)(?:^|[^A-Za-z0-9_])(?:{negations})(?:\s+[A-Za-z0-9_']+){{0,{between}}}\s*\z"
    last = lambda c: F.right(c, F.lit(reach))

    def step(state: Column, x: Column) -> Column:
        before = last(F.concat(state["before"], x["piece"]))
        return F.struct(last(F.concat(before, x["cue"])).alias("before"), (state["found"] | ~before.rlike(negated)).alias("found"))

    pairs = F.zip_with(F.split(text, cue), _all(text, cue), lambda p, c: F.struct(p.alias("piece"), c.alias("cue")))
    start = F.struct(F.lit("").alias("before"), F.lit(False).alias("found"))
    return F.aggregate(F.filter(pairs, lambda x: x["cue"].isNotNull()), start, step, lambda state: state["found"])


def redact_cues(text: Column, cues: str, marker: str = "[cue]") -> Column:
    """Every cue as the marker, negated ones too."""
    return F.regexp_replace(text, f"(?i){_BEGIN}(?:{cues}){_END}", marker)


def drop_clauses(text: Column, cues: str, neutral: str = "") -> Column:
    """The clauses without a cue, joined by a space; the neutral text where none is left, NULL for NULL.

    Clauses end behind sentence ends and at line ends (written-out ``\\n`` too), and begin before numbers of a list such as ``2. ``.
    """
    parts = F.split(F.replace(text, F.lit("\\n"), F.lit("\n")), r"(?<=[.!?])\s+|\n+|(?<![0-9])(?=[0-9]+\.\s)")
    clauses = F.transform(parts, lambda c: F.btrim(c, F.lit(_SPACE)))
    kept = F.array_join(F.filter(clauses, lambda c: (c != "") & ~c.rlike(f"(?i){_BEGIN}(?:{cues}){_END}")), " ")
    return F.when(kept == "", neutral).otherwise(kept)


#: What stands before the visible answer in completions with channels.
FINAL_MARKERS = ["assistantfinal", "<|channel|>final<|message|>"]


def visible_part(text: Column, markers: list[str] | None = None) -> Column:
    """What follows the last of the markers, trimmed; the whole text, trimmed, where there is none."""
    for marker in FINAL_MARKERS if markers is None else markers:
        text = F.substring_index(text, marker, -1)
    return F.btrim(text, F.lit(_SPACE))


def split_reasoning(text: Column, tag: str = "think") -> Column:
    """``reasoning, visible``: both sides of the first closing tag, trimmed, without an opening tag at the begin; NULL where the tag is never closed."""
    close, trimmed = f"</{tag}>", lambda c: F.btrim(c, F.lit(_SPACE))
    at = F.locate(close, text)
    before = trimmed(F.substring_index(text, close, 1))
    reasoning = F.when(before.startswith(f"<{tag}>"), trimmed(F.substring(before, F.lit(len(tag) + 3), F.length(before)))).otherwise(before)
    visible = trimmed(F.substring(text, at + len(close), F.length(text)))
    return F.when(at > 0, F.struct(reasoning.alias("reasoning"), visible.alias("visible")))


def extract_tag(text: Column, tag: str) -> Column:
    """Contents of the last block of a tag, NULL where there is none."""
    return F.try_element_at(_all(text, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), F.lit(-1))


def text_shape(text: Column) -> list[Column]:
    n = lambda p: F.size(_all(text, p))
    return [F.log1p(F.length(text)).alias("log_chars"), n("[A-Za-z0-9]+").alias("tokens"), n("[.!?]+").alias("stops"), n("[0-9]+").alias("numbers"), n('"').alias("quotes"), n("[$€£]").alias("currencies")]


#: Phrases that refer to what was said, comparing words, units of money, and stems of history and cause.
REFERRING = ["the statement", "that claim", "that statement", "that answer", "this claim", "this statement", "as noted above", "as noted earlier", "as stated above", "as stated earlier", "as mentioned above", "as mentioned earlier", "yes", "no"]
COMPARING = "most least first last largest smallest highest lowest older younger greater less more earlier later best worst".split()
MONEY = "usd eur gbp dollar dollars euro euros pound pounds".split()
CAUSAL = ["founded", "established", "published", "invented", "discovered", "born", "died", "because", "caused", "led to", "resulted in", "therefore", "historically", "origin", "originated", "etymolog"]


def feature_patterns(begin: str = _BEGIN, end: str = _END, fresh: str = "(?<![A-Za-z0-9_])") -> dict[str, str]:
    """What ``text_features`` counts; the bounds of words are parameters for engines that write them otherwise."""
    word = lambda words, tail="": f"(?i){begin}(?:{'|'.join(words)}){tail}{end}"
    return {
        "sentences": r"[.!?]+(?:\s|\z)",
        "refs": word(REFERRING),
        "numbers": fresh + r"[+-]?(?:[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)%?",
        "years": f"{begin}(?:1[0-9]{{3}}|20[0-9]{{2}}|2100){end}",
        "currencies": rf"(?i)(?:[$€£¥]\s?[0-9]|{begin}(?:{'|'.join(MONEY)}){end})",
        "quoted": "\"[^\"]+\"|'[^']+'",
        "capitalised": rf"{begin}[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|of|the|and)){{1,4}}{end}",
        "comparatives": word(COMPARING),
        "causals": word(CAUSAL, "[A-Za-z0-9_]*"),
    }


def text_features(text: Column) -> list[Column]:
    """Logarithms of length and words, counts of nine patterns, and the factual density: numbers, currencies, quotes, capitalised spans, comparatives and causes together."""
    n = {name: F.regexp_count(text, F.lit(p)) for name, p in feature_patterns().items()}
    words = F.regexp_count(text, F.lit(rf"[^{_SPACE}]+"))
    density = sum((n[name] for name in ("currencies", "quoted", "capitalised", "comparatives", "causals")), n["numbers"])
    return [F.log1p(F.length(text)).alias("log_chars"), F.log1p(words).alias("log_words"), *[c.alias(name) for name, c in n.items()], density.alias("density")]


def logit(p: Column, eps: float = 1e-8) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(x: Column, bound: float = 40.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-bound)), F.lit(bound))))


def log_odds_blend(columns: list[Column], weights: list[float]) -> Column:
    """Weighted mean of log odds, as a probability."""
    total = F.lit(0.0)
    for c, w in zip(columns, weights, strict=True):
        total = total + logit(c) * w
    return sigmoid(total / sum(weights))


def expected_rating(shares: Column, low: float, high: float) -> Column:
    """Mean of a rating -> mass map on a scale of 0 to 1; 0.5 where the mass is 0."""
    mass = F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(F.map_entries(shares), F.lit(0.0), lambda a, e: a + (e["key"] - low) / (high - low) * e["value"])
    return F.when(mass > 0, mean / mass).otherwise(0.5)


def verdict(support: Column, neutral: Column, contradict: Column, least: float) -> Column:
    """The stronger side if it reaches the least confidence and neutral does not dominate; ties go to support."""
    best = F.greatest(support, contradict)
    return F.when((best < least) | (neutral > best), "NOT_ENOUGH_INFO").when(support >= contradict, "SUPPORTS").otherwise("REFUTES")
