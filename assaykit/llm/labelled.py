"""Which labelled rows a model may learn from, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textio import cut


def fold(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def fit_rows(docs: DataFrame, labels: DataFrame, column: str, most: int, seed: int = 5, most_bytes: int | None = None) -> DataFrame:
    """At most ``most`` labelled rows (text, y) outside the held-out fold, the first in the order of a seeded hash.

    The bound is the documented size of the fitting sample: rows that leave the executors do not grow with the table.
    With ``most_bytes`` the sample is written, and ends where the sum of its texts' bytes would exceed that.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold() != 1)).select(F.col("doc_id").alias("id"), F.col(column).cast("int").alias("y"))
    known = known.dropDuplicates(["id"]).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("id", F.coalesce("text", F.lit("")).alias("text"), "y")
    if most_bytes is None:
        return rows
    upto = Window.orderBy(F.xxhash64(F.lit(seed), "id"), "id", "text").rowsBetween(Window.unboundedPreceding, 0)  # over the sample alone
    return cut(rows).withColumn("b", F.sum(F.octet_length("text").cast("long")).over(upto)).filter(F.col("b") <= most_bytes).drop("b")
