"""Two-pass external shuffle into shards.

Pass one scatters the records over buckets that fit in memory, by a seeded hash
of the record; pass two draws a Fisher-Yates permutation of each bucket. The
place of a record in the whole order, dealt round-robin, gives shard and slot:
shard sizes differ by one row at most (the law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textio import cut

BUCKET_BYTES = 24_000_000
MOST_READERS = 20_000  # tasks of pass two; beyond that a task takes a range of buckets, one after the other
_BUCKET, _HASH, _OFFSET = "__bucket", "__hash", "__offset"


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of n places; numpy's shuffle is the Fisher-Yates walk."""
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)
    return order


def _identity(df: DataFrame, seed: int):
    """A seeded hash of the whole record, whatever its columns are."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith(("map", "void", "variant"))])


def shuffle_shards(df: DataFrame, n_shards: int, seed: int = 17, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``df`` plus ``shard`` int and ``slot`` long, in a uniform random order that the seed fixes.

    Every row is kept, repeated rows as often as they come; rows equal in every column are interchangeable,
    and a salt from their place in the input spreads them over the buckets. Null texts weigh one byte. An
    empty table gives no rows. Columns named shard or slot are replaced. The texts are written once, by the scatter
    of pass one, and moved once; a bucket holds about ``bucket_bytes`` of text, whatever the size of the table.
    """
    df = df.drop("shard", "slot", _BUCKET, _HASH, _OFFSET)
    n_bytes, n_rows = df.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = max(1, min(-(-n_bytes // bucket_bytes), n_rows))
    # Pass one is written: counts and permutations then see one and the same scatter, whatever order rows arrived in.
    salted = df.withColumn(_HASH, _identity(df, seed)).withColumn(_BUCKET, F.pmod(F.xxhash64(F.col(_HASH), F.monotonically_increasing_id()), F.lit(n_buckets)).cast("int"))
    salted = cut(salted)
    counts = salted.groupBy(_BUCKET).count()
    offsets = counts.select(_BUCKET, (F.sum("count").over(Window.orderBy(_BUCKET)) - F.col("count")).alias(_OFFSET))  # one row a bucket
    offset_of = np.zeros(n_buckets, np.int64)
    for b, o in offsets.toLocalIterator():
        offset_of[b] = o
    sent = df.sparkSession.sparkContext.broadcast(offset_of)  # eight bytes a bucket, once an executor
    at_bucket = salted.columns.index(_BUCKET)
    fields = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def permute(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:  # in the order of the buckets
            buckets = batch.column(at_bucket).to_numpy()
            edges = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b and held and held[0].column(at_bucket)[0].as_py() != buckets[a]:
                    yield from permuted(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from permuted(held)

    def permuted(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held)
        b = int(table.column(_BUCKET)[0].as_py())
        body = table.drop_columns([_BUCKET, _HASH])
        rows = np.argsort(table.column(_HASH).to_numpy(), kind="stable")  # the order of arrival must not matter
        place = sent.value[b] + np.arange(len(rows), dtype=np.int64)
        picked = rows[fisher_yates(len(rows), [seed, b])]
        for at in range(0, len(picked), 1000):
            part = body.take(pa.array(picked[at : at + 1000])).combine_chunks()
            p = place[at : at + 1000]
            for x in part.append_column("shard", pa.array((p % n_shards).astype(np.int32))).append_column("slot", pa.array(p // n_shards)).to_batches():
                yield x

    a_task = -(-n_buckets // MOST_READERS)
    dealt = salted.repartitionById(-(-n_buckets // a_task), F.expr(f"{_BUCKET} div {a_task}").cast("int"))
    return (dealt.sortWithinPartitions(_BUCKET) if a_task > 1 else dealt).mapInArrow(permute, fields)


def write_shards(df: DataFrame, path: str, n_shards: int, seed: int = 17) -> None:
    """Write the shards as ``path/shard=k/``, each sorted by slot within its files."""
    out = shuffle_shards(df, n_shards, seed)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
