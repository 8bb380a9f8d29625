"""Record assembly, unions, variants and feature banks, and audits of caches and conditions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import terms

MOST_TEMPLATES = 10_000


def assemble(df: DataFrame, templates: DataFrame, key: str, text: str, refs: DataFrame | None = None) -> DataFrame:
    """``key, template, record``: each row under each template (``template, head, tail``), with its reference block if it has one.

    More than ``MOST_TEMPLATES`` templates are an error: every task holds all of them.
    """
    if templates.limit(MOST_TEMPLATES + 1).count() > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    rows = df.select(key, text)
    rows = rows.join(refs.select(key, "reference"), key, "left") if refs is not None else rows.withColumn("reference", F.lit(None).cast("string"))
    block = F.when(F.col("reference").isNotNull(), F.concat(F.lit("<reference>"), "reference", F.lit("</reference>")))
    return rows.join(F.broadcast(templates)).select(key, "template", F.concat_ws("\n", "head", block, F.col(text), "tail").alias("record"))


def union_tagged(tables: dict[str, DataFrame], key: str, identity: str | None = None) -> DataFrame:
    """All rows with the name of their table as ``origin``; an identity (the key, and one more column for variants) found twice is an error."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("origin", F.lit(n)) for n, t in tables.items()])
    if not out.groupBy(key, *([identity] if identity else [])).count().filter("count > 1").isEmpty():
        raise ValueError("an identity comes twice")
    return out


def keys_intersect(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "member", value: str = "value", scale: float = 1.0) -> DataFrame:
    """One row a key and member; values divided by the scale."""
    return df.select(*keys, *[(F.col(c) / scale).alias(c) for c in columns]).unpivot(keys, columns, name, value)


def flatten_claims(df: DataFrame, key: str, claims: str, text: str) -> DataFrame:
    """``key, position, claim, quote``: claims (array of claim, quote) whose quote is part of the text; of one claim text the first stays."""
    rows = df.select(key, text, F.posexplode(claims).alias("position", "c")).select(key, text, "position", "c.claim", "c.quote")
    grounded = rows.filter((F.col("quote") != "") & F.col(text).contains(F.col("quote")))
    return grounded.groupBy(key, "claim").agg(F.min(F.struct("position", "quote")).alias("f")).select(key, "f.position", "claim", "f.quote")


def expand_variants(df: DataFrame, key: str, evidence: str, donors: DataFrame) -> DataFrame:
    """``key, variant, evidence, origin``: each row with its own, no, and its donor's evidence (``donors (key, donor)``), and whose that is."""
    own = df.select(key, F.lit("real").alias("variant"), F.col(evidence).alias("evidence"), F.col(key).alias("origin"))
    empty = df.select(key, F.lit("empty").alias("variant"), F.lit("").alias("evidence"), F.lit(None).cast(df.schema[key].dataType).alias("origin"))
    given = donors.join(df.select(F.col(key).alias("donor"), F.col(evidence).alias("evidence")), "donor").select(key, F.lit("shuffled").alias("variant"), "evidence", F.col("donor").alias("origin"))
    return own.unionByName(empty).unionByName(given)


def mixed_variants(df: DataFrame, key: str, evidence: str, donors: DataFrame) -> DataFrame:
    """As ``expand_variants``, a variant ``mixed``: a row's own evidence, and its donor's on the next line."""
    given = donors.join(df.select(F.col(key).alias("donor"), F.col(evidence).alias("__given")), "donor")
    both = F.concat(F.coalesce(evidence, F.lit("")), F.lit("\n"), F.coalesce("__given", F.lit("")))
    return df.join(given, key).select(key, F.lit("mixed").alias("variant"), both.alias("evidence"), F.col("donor").alias("origin"))


def picked_variants(picks: DataFrame, candidates: DataFrame, key: str, candidate: str, evidence: str) -> DataFrame:
    """``key, variant, evidence, origin``: the evidence of the candidates that ``evidence.pick_candidate`` chose, ``harmful``, ``helpful`` and ``insufficient``.

    ``candidates (key, candidate, evidence)``; rows for which nothing was picked have no such variant, and NULL evidence is empty.
    """
    chosen = picks.select(key, "harmful", "helpful", F.col("rejected").alias("insufficient")).unpivot(key, ["harmful", "helpful", "insufficient"], "variant", "origin").filter("origin IS NOT NULL")
    texts = candidates.select(key, F.col(candidate).alias("origin"), F.coalesce(evidence, F.lit("")).alias("evidence"))
    return chosen.join(texts, [key, "origin"]).select(key, "variant", "evidence", "origin")


def feature_bank(base: DataFrame, tables: dict[str, DataFrame], key: str, neutral: float = 0.5) -> DataFrame:
    """The base with one column a table (``key, score``); rows that a table lacks get the neutral value, a NULL score in a table is an error."""
    out = base
    for name, t in tables.items():
        seen = t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("k"), F.count_if(F.col("score").isNull()).alias("nulls")).first()
        if seen["n"] != seen["k"] or seen["nulls"]:
            raise ValueError(f"{name}: {seen['n'] - seen['k']} repeated keys, {seen['nulls']} scores that are NULL")
        out = out.join(t.select(key, F.col("score").alias(name)), key, "left").fillna(neutral, [name])
    return out


def audit_conditions(baseline: DataFrame, real: DataFrame, shuffled: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """One row for three caches (``key, prompt, output``) of the same keys and the evidence (``key, evidence``) of the real one.

    Rows of all three, rows whose prompts are equal, outputs changed by real and by shuffled evidence, and of the new terms of the
    changed real outputs those that come from the evidence.
    """
    part = lambda d, n: d.select(key, F.col("prompt").alias(f"p{n}"), F.col("output").alias(f"o{n}"))
    j = part(baseline, 0).join(part(real, 1), key).join(part(shuffled, 2), key).join(evidence, key, "left")
    new = F.array_except(terms(F.col("o1")), terms(F.col("o0")))
    n = j.select("p0", "p1", "p2", "o0", "o1", "o2", F.coalesce(F.size(new), F.lit(0)).alias("new"), F.coalesce(F.size(F.array_intersect(new, terms(F.col("evidence")))), F.lit(0)).alias("grounded"))
    same = F.col("p0").eqNullSafe(F.col("p1")) & F.col("p0").eqNullSafe(F.col("p2"))
    changed = lambda i: ~F.col("o0").eqNullSafe(F.col(f"o{i}"))
    return n.agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("same_prompts"), F.count_if(changed(1)).alias("changed_real"), F.count_if(changed(2)).alias("changed_shuffled"), F.sum("new").alias("new_terms"), F.sum("grounded").alias("grounded_terms"))


def audit_variants(df: DataFrame, key: str, variant: str, label: str, text: str, block: str, leak: str) -> DataFrame:
    """``rule, violations``: (key, variant) repeated, empty texts, labels that change within a key, evidence blocks other than one, label tags in the text, imbalance of labels over 1."""
    blocks = F.regexp_count(text, F.lit(block))
    rows = df.groupBy(key, variant).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"), F.count_if(F.coalesce(F.trim(text), F.lit("")) == "").alias("empty"), F.count_if(F.coalesce(blocks, F.lit(0)) != 1).alias("blocks"), F.count_if(F.col(text).rlike(leak)).alias("leaks"))
    keys = rows.groupBy(key).agg(F.sum(F.col("n") - 1).alias("repeated"), (F.min("lo") != F.max("hi")).cast("int").alias("labels"), *[F.sum(c).alias(c) for c in ("empty", "blocks", "leaks")], F.min("lo").alias("label"))
    imbalance = F.greatest(F.lit(0), F.abs(F.count_if(F.col("label") == 1) - F.count_if(F.col("label") == 0)) - 1)
    one = keys.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("repeated", "empty", "labels", "blocks", "leaks")], imbalance.alias("imbalance"))
    return one.unpivot([], ["repeated", "empty", "labels", "blocks", "leaks", "imbalance"], "rule", "violations")


def mark_label_only(df: DataFrame, manifest: DataFrame, key: str, label: str) -> DataFrame:
    """All rows with ``label_only``: whether the manifest lists their key; a listed key that is missing or labelled otherwise is an error."""
    listed = manifest.groupBy(key).agg(F.min(label).alias("__l"))
    bad = listed.join(df.groupBy(key).agg(F.min(label).alias("__have")), key, "left").filter(~F.col("__l").eqNullSafe(F.col("__have"))).count()
    if bad:
        raise ValueError(f"{bad} listed keys are missing or labelled otherwise")
    return df.join(listed, key, "left").withColumn("label_only", F.col("__l").isNotNull()).drop("__l")


