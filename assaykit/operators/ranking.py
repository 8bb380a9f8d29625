"""A linear ranker of candidates on hashed features, trained on pairs of candidates of one question."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrowtext import cut
from ..functions.parsing import hash_features
from ..functions.scalar import ratio, stable_digest, stable_fraction

NEGATIVES = 16  # of a question, the first by digest, that each of its right candidates is set against
FOLDS = 10


def sides(question: str, seed: str) -> F.Column:
    """Fold 0 of a question's digest tests, fold 1 calibrates, the others fit."""
    fold = F.floor(stable_fraction(seed, question) * FOLDS)
    return F.when(fold == 0, "test").when(fold == 1, "calibrate").otherwise("fit")


def _pairs(rows: DataFrame, question: str, candidate: str, seed: str) -> DataFrame:
    """``question, right, wrong, up`` of the fitting side: each right candidate with up to ``NEGATIVES`` wrong ones; every other pair is turned round."""
    own = rows.select(question, candidate, "label", "side").filter("side = 'fit'")
    order = Window.partitionBy(question).orderBy(stable_digest(seed, candidate), candidate)
    wrong = own.filter("label = 0").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= NEGATIVES)
    met = own.filter("label = 1").select(question, F.col(candidate).alias("right")).join(wrong.select(question, F.col(candidate).alias("wrong")), question)
    return met.withColumn("up", (stable_fraction(seed, question, "right", "wrong") < 0.5).cast("int"))


def fit_ranker(rows: DataFrame, question: str, candidate: str, bits: int = 13, c: float = 1.0, seed: str = "rank", least_precision: float = 0.8, least_emitted: int = 5) -> tuple[DataFrame, float]:
    """``rows (question, candidate, label 0 or 1, features)`` with ``side, score, place`` by a linear ranker, and the threshold of its best candidates.

    ``features`` is an array of (name, value); names share 2**bits slots by their CRC-32. A model of differences learns which candidate of a
    pair is right; a candidate's score is its own product with the weights. On the calibrating questions the threshold is the one
    with most right first candidates among those that emit at least ``least_emitted`` with a precision of at least ``least_precision`` (ties:
    more emitted, then the higher), and above all scores if there is none. Without a pair all scores are 0. Rows without a question
    or candidate are left out; ties of scores go to the smaller candidate.
    """
    spark = rows.sparkSession
    known = cut(rows.filter(F.col(question).isNotNull() & F.col(candidate).isNotNull() & F.col("label").isNotNull()).withColumn("side", sides(question, seed)))
    keyed = known.withColumn("__id", F.struct(question, candidate))
    slots = cut(hash_features(keyed, "__id", F.col("features"), bits).select(F.col(f"__id.{question}").alias(question), F.col(f"__id.{candidate}").alias(candidate), "slot", "value"))
    pairs = _pairs(known, question, candidate, seed)
    sign = lambda end, s: pairs.join(slots.withColumnRenamed(candidate, end), [question, end]).select(question, "right", "wrong", "up", "slot", (F.col("value") * s).alias("v"))
    turned = F.when(F.col("up") == 1, F.col("v")).otherwise(-F.col("v"))
    cells = sign("right", 1.0).unionByName(sign("wrong", -1.0)).groupBy(question, "right", "wrong", "up", "slot").agg(F.sum(turned).alias("v")).filter("v <> 0")
    grouped = cells.groupBy(question, "right", "wrong", F.col("up").cast("double").alias("label")).agg(F.array_sort(F.collect_list(F.struct("slot", "v"))).alias("e"))
    width = 2**bits
    sparse = F.udf(lambda e: Vectors.sparse(width, [x["slot"] for x in e], [x["v"] for x in e]), VectorUDT())
    table = cut(grouped.select("label", sparse("e").alias("features")))
    n, labels = table.agg(F.count(F.lit(1)), F.count_distinct("label")).first()
    if labels == 2:
        model = LogisticRegression(fitIntercept=False, standardization=False, regParam=1 / (c * n), maxIter=100).fit(table)
        weights = [(i, float(v)) for i, v in enumerate(model.coefficients.toArray()) if v]
    else:
        weights = []
    learnt = F.broadcast(spark.createDataFrame(weights, "slot int, weight double"))  # at most 2**bits rows
    scores = slots.join(learnt, "slot").groupBy(question, candidate).agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    out = known.join(scores, [question, candidate], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9))
    out = cut(out.withColumn("place", F.row_number().over(Window.partitionBy(question).orderBy(F.desc("score"), candidate))))
    first = out.filter("side = 'calibrate' AND place = 1").groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("right"))
    upto = Window.orderBy(F.desc("score"))  # one row for each distinct first score of a tenth of the questions
    points = first.select("score", F.sum("n").over(upto).alias("emitted"), F.sum("right").over(upto).alias("right"))
    best = points.filter((F.col("emitted") >= least_emitted) & (ratio(F.col("right"), F.col("emitted")) >= least_precision)).orderBy(F.desc("right"), F.desc("emitted"), F.desc("score")).first()
    top = out.agg(F.max("score")).first()[0]
    return out.drop("features"), (best["score"] if best else (top or 0.0) + 1e-6)


def ranking_report(ranked: DataFrame, question: str, k: int, threshold: float) -> DataFrame:
    """``side, questions, answerable, top_1, top_k, emitted, right``: how often a right candidate is first or among the k first, and at the threshold."""
    by = ranked.groupBy("side", question).agg(
        F.max("label").alias("any"),
        F.max(F.when(F.col("place") == 1, F.col("label"))).alias("one"),
        F.max(F.when(F.col("place") <= k, F.col("label"))).alias("some"),
        F.max(F.when(F.col("place") == 1, F.col("score"))).alias("score"),
    )
    said = F.col("score") >= threshold
    return by.groupBy("side").agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum("any").alias("answerable"),
        ratio(F.sum("one"), F.sum("any")).alias("top_1"),
        ratio(F.sum("some"), F.sum("any")).alias("top_k"),
        F.count_if(said).alias("emitted"),
        F.count_if(said & (F.col("one") == 1)).alias("right"),
    )
