"""Joins of predictions with labels, of facts with claims, of names with entities, and donors from other units."""

from __future__ import annotations

import dataclasses
import functools
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.arrowtext import among, cut, small_batches, tidy
from ..functions.parsing import terms
from ..functions.scalar import normalised, stable_digest
from .ranks import digest_places

MOST_IN_TASKS = 1_000_000  # words of names and terms of texts that each task may know
CELLS_A_STEP = 2_000_000  # counts, one for each mention and name, that a task holds at a time
_TERM = re.compile("[a-z0-9]+")


def align(preds: DataFrame, labels: DataFrame, key: str = "index", partial: bool = False) -> DataFrame:
    """Labels with their predictions. Strict: equal counts and a prediction for every label; partial: those that match, at least one."""
    if partial:
        out = labels.join(preds, key)
        if out.isEmpty():
            raise ValueError("no predicted key matched the labels")
        return out
    out = labels.join(preds.withColumn("__has", F.lit(True)), key, "left")
    n_preds, n_labels = preds.count(), labels.count()
    if n_preds != n_labels:
        raise ValueError(f"prediction count {n_preds} != label count {n_labels}")
    lost = out.filter("__has IS NULL").count()
    if lost:
        raise ValueError(f"{lost} labels had no prediction")
    return out.drop("__has")


def manifest_report(df: DataFrame, manifest: DataFrame, key: str, label: str) -> DataFrame:
    """Every key of the manifest as ``selected``, ``unavailable`` or ``mismatch`` (labels differ); equal keys of the table count once."""
    have = df.groupBy(key).agg(F.min(label).alias("__l"), F.lit(True).alias("__has"))
    want = manifest.groupBy(key).agg(F.min(label).alias("__w"))
    status = F.when(F.col("__has").isNull(), "unavailable").when(~F.col("__l").eqNullSafe(F.col("__w")), "mismatch").otherwise("selected")
    return want.join(have, key, "left").select(key, status.alias("status"))


def relation_evidence(claims: DataFrame, facts: DataFrame, functional: list[str], inverse: dict[str, str]) -> DataFrame:
    """Status of each claim (claim, subject, predicate, object) by facts (subject, predicate, object) and the inverse predicates.

    ``support`` if a fact says it; ``counter`` if the predicate is functional and exactly one other object is known; else ``neutral``.
    """
    back = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair]) if inverse else F.create_map().cast("map<string,string>")
    turned = facts.withColumn("p", back[F.col("predicate")]).filter("p IS NOT NULL").select(F.col("object").alias("subject"), F.col("p").alias("predicate"), F.col("subject").alias("object"))
    known = facts.select("subject", "predicate", "object").unionByName(turned).distinct().withColumnRenamed("object", "known")
    found = claims.join(known, ["subject", "predicate"], "left").groupBy("claim", "predicate").agg(F.count_if(F.col("known") == F.col("object")).alias("same"), F.count("known").alias("n"))
    status = F.when(F.col("same") > 0, "support").when(F.col("predicate").isin(functional) & (F.col("n") == 1), "counter").otherwise("neutral")
    return found.select("claim", status.alias("status"))


def _name(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.md5(text))


def _shared_words(one: DataFrame, two: DataFrame, least: int) -> DataFrame:
    """``a, b, n``: the ``_name`` of pairs of distinct texts of two tables (m) with at least so many words in common, and how many.

    Only words of both tables count, ordered by how rarely texts hold them. Two sets share ``least`` words only if they share one of their first
    (size - least + 1), so texts meet by rare words alone and a word that stands in every text is joined by none that has enough others.
    Texts go by their names, so that no text is sent with each of its words.
    """
    words = lambda d: d.select(_name(F.col("m")).alias("id"), F.explode(F.array_distinct(F.split("m", " "))).alias("w"))
    right = cut(words(two).distinct())
    left = cut(words(one).join(right.select("w").distinct(), "w", "left_semi").distinct())
    right = right.join(left.select("w").distinct(), "w", "left_semi")
    df = cut(left.unionByName(right).groupBy("w").agg(F.count(F.lit(1)).alias("df")))

    def listed(d: DataFrame) -> DataFrame:
        rows = d.join(df, "w").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("s"))
        return cut(rows.filter(F.size("s") >= least).select("id", F.transform("s", lambda x: x["w"]).alias("ws")))

    lists = [listed(d).toDF(n, f"{n}_ws") for n, d in (("a", left), ("b", right))]
    firsts = [d.select(n, F.explode(F.slice(f"{n}_ws", 1, F.size(f"{n}_ws") - (least - 1))).alias("w")) for n, d in zip("ab", lists, strict=True)]
    pairs = firsts[0].join(firsts[1], "w").select("a", "b").distinct()
    met = pairs.join(lists[0], "a").join(lists[1], "b")
    return met.select("a", "b", F.size(F.array_intersect("a_ws", "b_ws")).alias("n")).filter(F.col("n") >= least)


def _terms(text: str) -> Column:
    return terms(F.coalesce(F.col(text), F.lit("")), 3)


def _fitting(pattern: str, expected: list[str]) -> tuple[Column, Column]:
    """Whether a question matches the pattern of a hint, and whether an entity's text holds one of its words."""
    fits = F.lit(False)
    for word in expected:
        fits = fits | F.contains(F.lower("about"), F.lit(word))
    return F.coalesce(F.lower("question").rlike(pattern), F.lit(False)), F.coalesce(fits, F.lit(False))


@dataclasses.dataclass
class _Names:
    """Names and texts of all entities: which names hold a word, which entities have a name, which hints an entity fits, its terms."""

    entities: pa.Array
    names: dict[str, int]
    vocabulary: dict[str, int]
    first: np.ndarray  # names of word w: name[first[w] : first[w + 1]]
    name: np.ndarray
    owner: np.ndarray  # entities of name m: entity[owner[m] : owner[m + 1]]
    entity: np.ndarray
    fits: np.ndarray
    known: list[frozenset]

    @staticmethod
    def of(named: list[tuple[int, str]], entities: pa.Array, fits: np.ndarray, known: list[frozenset]) -> _Names:
        names = {m: k for k, m in enumerate(sorted({m for _, m in named}))}
        words = [(w, k) for m, k in names.items() for w in set(m.split(" "))]
        vocabulary = {w: k for k, w in enumerate(sorted({w for w, _ in words}))}

        def listed(pairs: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
            table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            return np.searchsorted(table[:, 0], np.arange(n + 1)), table[:, 1]

        first, name = listed([(vocabulary[w], k) for w, k in words], len(vocabulary))
        owner, entity = listed([(names[m], e) for e, m in named], len(names))
        return _Names(entities, names, vocabulary, first, name, owner, entity, fits, known)


def _spread(first: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each item its places in the list that ``first`` cuts: (number of the item, place)."""
    n = first[items + 1] - first[items]
    of = np.repeat(np.arange(len(items)), n)
    return of, np.repeat(first[items] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _scores(names: _Names, mentions: list[str], least: float, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, entity, score`` of all entities whose best name reaches the least, in order of row and entity."""
    found = [[names.vocabulary[w] for w in set(m.split(" ")) if w in names.vocabulary] for m in mentions]
    flat = np.fromiter(itertools.chain.from_iterable(found), np.int64)
    item, at = _spread(names.first, flat)
    row = np.repeat(np.arange(len(mentions)), [len(x) for x in found])[item]
    n_names = len(names.names)
    counts = np.bincount(row * n_names + names.name[at], minlength=len(mentions) * n_names)
    cells = np.flatnonzero(counts >= words)
    own = np.array([names.names.get(m, -1) for m in mentions], np.int64)
    alike = np.flatnonzero(own >= 0)
    cells = cells[own[cells // n_names] != cells % n_names]
    row = np.concatenate([cells // n_names, alike])
    score = np.concatenate([20.0 + 10 * counts[cells], np.full(len(alike), 100.0)])
    same = np.concatenate([np.zeros(len(cells), bool), np.ones(len(alike), bool)])
    kept = np.flatnonzero(score >= least)
    item, at = _spread(names.owner, np.concatenate([cells % n_names, own[alike]])[kept])
    row, score, same, entity = row[kept][item], score[kept][item], same[kept][item], names.entity[at]
    # An equal name counts as 100 even where more words are shared than that is worth.
    order = np.lexsort((score, same, entity, row))
    row, entity = row[order], entity[order]
    last = np.flatnonzero(np.concatenate([(row[1:] != row[:-1]) | (entity[1:] != entity[:-1]), [True]])) if len(row) else order
    return row[last], entity[last], score[order][last]


def _linked(sent, n_hints: int, with_context: bool, least: float, words: int, margin: float, limit: int):
    """Links of claims whose id comes once, from columns claim, m, and with context question, values (lower case) and whether the question matches each hint."""

    def run(batches):
        names: _Names = sent.value
        step = max(1, CELLS_A_STEP // max(1, len(names.names)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                mentions = some.column(1).to_pylist()
                row, entity, score = _scores(names, mentions, least, words)
                for h in range(n_hints):
                    kept = ~some.column(4 + h).to_numpy(zero_copy_only=False)[row] | names.fits[h][entity]
                    row, entity, score = row[kept], entity[kept], score[kept]
                # Only entities that fewer than limit + 1 others surpass can stand among the first, or next to the last of them.
                order = np.lexsort((entity, -score, row))
                row, entity, score = row[order], entity[order], score[order]
                begin = np.searchsorted(row, row)
                floor = np.minimum(begin + limit, np.searchsorted(row, row, side="right") - 1)
                kept = score >= score[floor]
                row, entity, score = row[kept], entity[kept], score[kept]
                context = np.zeros(len(row), np.int64)
                if with_context:
                    bounds = np.searchsorted(row, np.arange(len(mentions) + 1))
                    for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                        values, asked = ({t for t in _TERM.findall(some.column(c)[i].as_py()) if len(t) >= 3} for c in (3, 2))
                        asked -= set(mentions[i].split(" "))
                        for j in range(bounds[i], bounds[i + 1]):
                            known = names.known[entity[j]]
                            context[j] = 12 * len(values & known) + 3 * len(asked & known)
                order = np.lexsort((entity, -context, -score, row))
                row, entity, score, context = row[order], entity[order], score[order], context[order]
                begin = np.searchsorted(row, row)
                follows = np.concatenate([row[1:] == row[:-1], [False]])[: len(row)]
                near = follows & (score - np.roll(score, -1) < margin) & (context - np.roll(context, -1) < margin)
                kept = ~near[begin] & (np.arange(len(row)) - begin < limit) if len(row) else follows
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row[kept])), names.entities.take(pa.array(entity[kept])), pa.array(score[kept])], names=["claim", "entity", "score"])

    return tidy(run)


def _all_names(e: DataFrame, texts: DataFrame | None, hints: list[tuple[str, list[str]]]) -> _Names | None:
    """All that tasks need to know of the entities, or None if they have more than ``MOST_IN_TASKS`` words."""
    named = e.select("entity", "m").distinct()
    known = named.select("entity").distinct() if texts is None else texts.withColumn("known", _terms("about")).withColumns({f"h{k}": _fitting(*hint)[1] for k, hint in enumerate(hints)}).drop("about")
    named, known = cut(named), cut(known)
    size = named.agg(F.sum(F.size(F.split("m", " "))).alias("n")).first()["n"] or 0
    if texts is not None:
        size += known.agg(F.sum(F.size("known")).alias("n")).first()["n"] or 0
    if size > MOST_IN_TASKS:
        return None
    # Entities by their order, in which ties are decided.
    rows = known.orderBy("entity").toArrow().combine_chunks()
    entities = rows.column("entity").combine_chunks()
    place = {x: k for k, x in enumerate(entities.to_pylist())}
    pairs = [(place[r["entity"]], r["m"]) for r in named.toArrow().to_pylist()]
    fits = np.array([rows.column(f"h{k}").to_pylist() for k in range(len(hints) if texts is not None else 0)], bool)
    return _Names.of(pairs, entities, fits, [frozenset(x) for x in rows.column("known").to_pylist()] if texts is not None else [])


def link_entities(claims: DataFrame, entities: DataFrame, least: float = 70.0, margin: float = 3.0, limit: int = 1, hints: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """``claim, entity, score``: the entity of a mention: 100 for an equal normalised name, else 20 + 10 for each shared word.

    ``claims (claim, mention)`` and, for the context, ``question`` and ``values``; ``entities (entity, name)``, one row for each name or alias, and
    ``about``, a text of the entity. The best of an entity's names counts. Scores under the least are dropped, and entities whose
    text holds no word of a hint ``(pattern, words)`` whose pattern the question matches. Equal scores go by context, then to the
    smaller entity. Where neither score nor context parts the two best by the margin, a claim is left unlinked.

    Names of up to ``MOST_IN_TASKS`` words are known to every task, which links the claims it reads, so neither texts nor pairs are
    shuffled. Claims whose id comes more than once, and all claims where there are more names, meet the names by joins.
    """
    with_context = {"question", "values"} <= set(claims.columns) and "about" in entities.columns
    c = claims.withColumn("m", normalised(F.col("mention"))).filter("m <> ''")
    e = entities.withColumn("m", normalised(F.col("name"))).filter("m <> ''")
    texts = None
    if with_context:
        c, e = c.filter("claim IS NOT NULL"), e.filter("entity IS NOT NULL")
        texts = e.groupBy("entity").agg(F.max("about").alias("about"))
    small_batches(claims.sparkSession)
    if (names := _all_names(e, texts, hints)) is None:
        return _linked_by_joins(c, e, texts, least, margin, limit, hints)
    twice = cut(c.groupBy("claim").count().filter("count > 1").select("claim"))
    once, more = c, None
    if not twice.isEmpty():
        some = among(twice)(F.col("claim"))
        once, more = c.filter(~some), _linked_by_joins(c.filter(some), e, texts, least, margin, limit, hints)
    told = [F.coalesce(F.lower(x), F.lit("")).alias(x) for x in ("question", "values")] + [_fitting(*hint)[0].alias(f"h{k}") for k, hint in enumerate(hints)] if with_context else []
    run = _linked(claims.sparkSession.sparkContext.broadcast(names), len(hints) if with_context else 0, with_context, least, _least_words(least), margin, limit)
    kinds = [claims.schema["claim"].dataType, entities.schema["entity"].dataType]
    out = once.select("claim", "m", *told).mapInArrow(run, StructType([StructField("claim", kinds[0]), StructField("entity", kinds[1]), StructField("score", DoubleType())]))
    return out if more is None else out.unionByName(more)


def _least_words(least: float) -> int:
    return max(1, int(-(-(least - 20) // 10)))


def _linked_by_joins(c: DataFrame, e: DataFrame, texts: DataFrame | None, least: float, margin: float, limit: int, hints: list[tuple[str, list[str]]]) -> DataFrame:
    """:func:`link_entities` of claims and entities with their normalised names ``m``, and of the entities' ``about``, which ``texts`` has if context counts."""
    asked, names = (d.select(k, _name(F.col("m")).alias("m")).distinct() for d, k in ((c, "claim"), (e, "entity")))
    same = asked.select("m").distinct().join(names.select("m").distinct(), "m").select("m", F.col("m").alias("name"), F.lit(100.0).alias("score"))
    shared = _shared_words(c, e, _least_words(least)).filter("a <> b").select(F.col("a").alias("m"), F.col("b").alias("name"), (20.0 + 10 * F.col("n")).alias("score"))
    pairs = same.unionByName(shared).filter(F.col("score") >= least)
    found = asked.join(pairs, "m").join(names.withColumnRenamed("m", "name"), "name")
    # An equal name counts as 100 even where more words are shared than that is worth.
    scored = found.groupBy("claim", "entity").agg(F.max(F.struct((F.col("m") == F.col("name")).alias("same"), "score"))["score"].alias("score"))
    context = F.lit(0)
    if texts is not None:
        scored = cut(scored)
        fitting = [_fitting(*hint) for hint in hints]
        # Only claims that found an entity are read for their terms, each once; a pair carries terms, not texts.
        told = c.filter(among(scored.select("claim"))(F.col("claim"))).dropDuplicates(["claim"])
        told = told.select("claim", F.array_except(_terms("question"), _terms("mention")).alias("asked"), _terms("values").alias("stated"), *[q.alias(f"q{k}") for k, (q, _) in enumerate(fitting)])
        about = texts.select("entity", _terms("about").alias("known"), *[f.alias(f"f{k}") for k, (_, f) in enumerate(fitting)])
        flags = told.select("claim", *[f"q{k}" for k in range(len(hints))]), about.drop("known")
        for d, key in zip(flags, ("claim", "entity"), strict=True):
            scored = scored.join(d, key)
        scored = scored.filter(functools.reduce(lambda a, k: a & (~F.col(f"q{k}") | F.col(f"f{k}")), range(len(hints)), F.lit(True))).select("claim", "entity", "score")
        # Only entities that fewer than limit + 1 others surpass can stand among the first, or next to the last of them.
        scored = scored.withColumn("s", F.rank().over(Window.partitionBy("claim").orderBy(F.desc("score")))).filter(F.col("s") <= limit + 1)
        scored = scored.join(told.select("claim", "asked", "stated"), "claim").join(about.select("entity", "known"), "entity")
        context = 12 * F.size(F.array_intersect("stated", "known")) + 3 * F.size(F.array_intersect("asked", "known"))
    w = Window.partitionBy("claim").orderBy(F.desc("score"), F.desc("context"), "entity")
    ranked = scored.withColumn("context", context).select("claim", "entity", "score", "context").withColumn("r", F.row_number().over(w))
    ranked = ranked.withColumn("next", F.lead("score").over(w)).withColumn("other", F.lead("context").over(w))
    near = (F.col("score") - F.col("next") < margin) & (F.col("context") - F.col("other") < margin)
    clear = F.max(F.when((F.col("r") == 1) & F.coalesce(near, F.lit(False)), 1).otherwise(0)).over(Window.partitionBy("claim")) == 0
    return ranked.withColumn("__c", clear).filter(F.col("__c") & (F.col("r") <= limit)).select("claim", "entity", "score")


def assign_donors(df: DataFrame, unit: str, key: str, seed: str = "donor") -> DataFrame:
    """``key, donor``: each row gets a row of the next unit in hashed order, at its own place plus half of that unit, wrapped round.

    Never of its own unit; with a single unit the donor is null.
    """
    order = Window.orderBy(stable_digest(seed, unit), unit)  # one row a unit
    units = df.groupBy(unit).agg(F.count(F.lit(1)).alias("n")).select(unit, "n", (F.row_number().over(order) - 1).alias("u"))
    n_units = units.agg(F.count(F.lit(1)).alias("k"))
    ring = units.join(F.broadcast(n_units)).withColumn("t", F.when(F.col("k") > 1, F.pmod(F.col("u") + 1, F.col("k"))))
    nexts = ring.join(units.select(F.col("u").alias("t"), F.col(unit).alias("target"), F.col("n").alias("m")), "t", "left").select(unit, "target", "m")
    placed = digest_places(df.select(unit, key), [unit], seed, key, "i").select(unit, key, (F.col("i") - 1).alias("i"))
    asks = placed.join(nexts, unit).withColumn("j", F.when(F.col("m").isNotNull(), F.pmod(F.col("i") + F.floor(F.col("m") / 2), F.col("m"))))
    gives = placed.select(F.col(unit).alias("target"), F.col("i").cast("long").alias("j"), F.col(key).alias("donor"))
    return asks.join(gives, ["target", "j"], "left").select(key, "donor")


def compose(prompts: DataFrame, targets: DataFrame, key: str, label: str, prompt: str) -> DataFrame:
    """Targets with the prompt of another cache for the same key and label; missing, duplicate or mismatched rows are an error."""
    left = targets.drop(prompt).groupBy(key).agg(F.count(F.lit(1)).alias("a"), F.min(label).alias("la"))
    right = prompts.groupBy(key).agg(F.count(F.lit(1)).alias("b"), F.min(label).alias("lb"))
    both = left.join(right, key, "full_outer")
    bad = both.agg(F.count_if(F.expr("a > 1 OR b > 1")).alias("twice"), F.count_if(F.expr("a IS NULL OR b IS NULL")).alias("missing"), F.count_if(F.expr("NOT la <=> lb")).alias("labels")).first()
    if bad["twice"] or bad["missing"] or bad["labels"]:
        raise ValueError(f"{bad['twice']} duplicate keys, {bad['missing']} missing rows, {bad['labels']} labels that differ")
    return targets.drop(prompt).join(prompts.select(key, prompt), key)


def resolve_redirects(edges: DataFrame, pages: DataFrame, most: int = 16) -> DataFrame:
    """``name, page``: the page that a name's redirects lead to. ``edges (name, target)``, ``pages (name, page)``.

    Pointers are doubled each round, so ``most`` rounds follow chains of up to 2**most steps; names in a cycle, or whose chain
    ends without a page, have none. A name with several targets takes the least; a name that is a page stays one. Both tables grow with
    the names, so no join sends one through the driver, small as its files may be.
    """
    p = pages.groupBy("name").agg(F.min("page").alias("page"))
    follow = edges.groupBy("name").agg(F.min("target").alias("target")).join(p.select("name").hint("merge"), "name", "left_anti")
    at = cut(follow.unionByName(p.select("name", F.col("name").alias("target"))))  # a page points to itself
    for _ in range(most):
        at = cut(at.join(at.select(F.col("name").alias("target"), F.col("target").alias("next")).hint("merge"), "target").select("name", F.col("next").alias("target")))
        if at.join(p.select(F.col("name").alias("target")).hint("merge"), "target", "left_anti").isEmpty():
            break
    return at.join(follow.select("name").hint("merge"), "name", "left_semi").join(p.withColumnRenamed("name", "target").hint("merge"), "target").select("name", "page")
