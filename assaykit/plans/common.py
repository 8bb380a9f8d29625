"""SQL of the canonical views, and rounding, shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6

P = "p AS (SELECT d.lang AS unit, d.source AS scenario, d.doc_id AS index, l.quality AS label, l.toxic, least(1.0::DOUBLE, d.n_chars / 20000.0::DOUBLE) AS score, (d.n_chars >= 1000)::INT AS decision FROM documents d JOIN labels l USING (doc_id))"
B = "b AS (SELECT unit, scenario, index, label, toxic, (index % 97) / 97.0::DOUBLE AS score, (index % 97 >= 40)::INT AS decision FROM p)"


def round_half(x, digits: int = DIGITS):
    """Rounding as SQL's ``round`` does it: the scaled double to the nearest whole number, halves away from zero.

    Spark rounds the shortest decimal form of the double instead, which differs where the double is not quite a half.
    """
    return F.round(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[round_half(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def with_confusion(table: str, by: str) -> str:
    """Balanced accuracy per group."""
    return f"SELECT {by}, (count(*) FILTER (label = 1 AND decision = 1) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE + 1 - count(*) FILTER (label = 0 AND decision = 1) / nullif(count(*) FILTER (label = 0), 0)::DOUBLE) / 2 AS ba FROM {table} GROUP BY {by}"
