"""What an ensemble would have decided had its outputs been cut: at a number of characters, at a marker, or at the first rating."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from ..functions.scalar import ratio


_RATINGS = ArrayType(StructType([StructField("upto", IntegerType()), StructField("value", IntegerType()), StructField("sure", BooleanType())]))


@F.arrow_udf(_RATINGS)
def _placed(sizes: pa.Array, values: pa.Array, sure: pa.Array) -> pa.Array:
    """Lists of sizes as running sums, with the two other lists beside them."""
    offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(sizes.value_lengths().to_numpy(zero_copy_only=False).astype(float)))]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
    upto = total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))
    rows = pa.StructArray.from_arrays([pa.array(upto.astype(np.int32)), values.flatten().cast(pa.int32()), sure.flatten()], names=["upto", "value", "sure"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows, mask=sizes.is_null())


def rating_stream(text: Column, pattern: str) -> Column:
    """The ratings of a text in order, as (``upto``, ``value``, ``sure``): where each ends, its last digit, and whether it also ends there if the text goes on.

    One pass of the pattern, which must match up to a digit, serves every cut: a text that is cut at n holds the ratings with ``upto``
    below n, if sure, and one that ends at n. Places are running sums of the lengths between and of the matches; no function of one
    rating looks at the whole text or at all ratings, so the work grows with the text.
    """
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    n = F.size(found)
    sizes = F.zip_with(F.slice(between, 1, n), found, lambda b, m: F.length(b) + F.length(m))
    values = F.transform(found, lambda m: F.right(m, F.lit(1)).cast("int"))
    # What follows a rating: the text up to the next one, or at once the next one, or nothing.
    sure = F.zip_with(F.slice(between, 2, n), F.slice(found, 2, n), lambda b, m: ~F.coalesce(F.when(F.length(b) > 0, b).otherwise(m), F.lit("")).rlike(r"^\w"))
    return _placed(sizes, values, sure)


def rating_at(stream: Column, upto: Column) -> Column:
    """The last rating of the text cut at a place, 0 where there is none."""
    held = F.filter(stream, lambda r: (r["upto"] < upto) & r["sure"] | (r["upto"] == upto))
    return F.coalesce(F.try_element_at(held, F.lit(-1))["value"], F.lit(0))


def replay_cuts(df: DataFrame, pattern: str, caps: list[int], marker: str, threshold: int = 2) -> DataFrame:
    """``cut, scope, rows, balanced_accuracy, agreement, chars, unrated``: of outputs as they are (``full``), cut at each cap, at the marker and at the first rating.

    ``df (unit, scenario, index, label, member, text)``; a row is decided if the greatest rating of its members reaches the threshold; a
    cut without a rating counts as 0. ``scope`` is ``all``, ``macro`` (mean over units that have both labels) or a scenario.
    ``agreement`` is the share of rows decided as in full, ``chars`` the share of characters kept, ``unrated`` the outputs without a
    rating; of these ``macro`` has those of all rows. Null texts count as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.length(text)
    seen = df.withColumn("__t", rating_stream(text, pattern)).withColumn("__n", size)
    at_marker = F.instr(text, F.lit(marker)) - 1
    first = F.try_element_at(F.filter("__t", lambda r: r["sure"]), F.lit(1))["upto"]
    cuts = [("full", size), *[(f"cap {c}", F.least(size, F.lit(c))) for c in caps]]
    cuts += [("marker", F.when(at_marker >= 0, at_marker).otherwise(size)), ("first rating", F.coalesce(first, size))]
    each = F.array(*[F.struct(F.lit(name).alias("cut"), place.cast("int").alias("upto")) for name, place in cuts])
    rows = seen.withColumn("__c", F.explode(each))
    rated = rows.select("unit", "scenario", "index", "label", "__n", F.col("__c.cut").alias("cut"), F.col("__c.upto").alias("upto"), rating_at(F.col("__t"), F.col("__c.upto")).alias("r"), rating_at(F.col("__t"), F.col("__n")).alias("f"))
    one = rated.groupBy("cut", "unit", "scenario", "index", "label").agg(
        (F.max("r") >= threshold).alias("d"), (F.max("f") >= threshold).alias("e"), F.sum("upto").alias("kept"), F.sum("__n").alias("n"), F.count_if(F.col("r") == 0).alias("unrated")
    )
    share = lambda y: ratio(F.count_if(F.col("d") & (F.col("label") == y)), F.count_if(F.col("label") == y))
    measures = [
        F.count(F.lit(1)).alias("rows"),
        ((share(1) + 1 - share(0)) / 2).alias("balanced_accuracy"),
        F.avg((F.col("d") == F.col("e")).cast("double")).alias("agreement"),
        ratio(F.sum("kept"), F.sum("n")).alias("chars"),
        F.sum("unrated").alias("unrated"),
    ]
    whole = one.groupBy("cut", F.lit("all").alias("scope")).agg(*measures)
    scenarios = one.groupBy("cut", F.col("scenario").alias("scope")).agg(*measures)
    macro = one.groupBy("cut", "unit").agg(*measures).groupBy("cut").agg(F.avg("balanced_accuracy").alias("ba"))
    means = whole.join(macro, "cut").select("cut", F.lit("macro").alias("scope"), "rows", F.col("ba").alias("balanced_accuracy"), "agreement", "chars", "unrated")
    return whole.unionByName(scenarios).unionByName(means)
