"""Scans with validation, keyed sinks and the append-only result ledger."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrowtext import shared_dir
from ..operators.sampling import sample_fraction

_TRUE, _FALSE = ["true", "1", "yes", "t", "1.0"], ["false", "0", "no", "f", "0.0"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_stems(df: DataFrame, folder: str, stem: str) -> None:
    """One CSV file for each value of a column (a table of few values), named after it; ``/`` becomes ``__``."""
    spark, Path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path
    df.withColumn("__stem", F.replace(stem, F.lit("/"), F.lit("__"))).drop(stem).repartition("__stem").write.option("header", True).partitionBy("__stem").csv(f"{folder}-parts")
    fs = Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(Path(folder))
    for part in fs.listStatus(Path(f"{folder}-parts")):
        name = part.getPath().getName()
        if name.startswith("__stem="):
            for file in fs.listStatus(part.getPath()):
                if file.getPath().getName().startswith("part-"):
                    fs.rename(file.getPath(), Path(f"{folder}/{name[len('__stem='):]}.csv"))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """``r`` (the object of a line) and ``_corrupt`` (the line, where it is none of the schema)."""
    fields = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_corrupt", T.StringType())])
    return lines.withColumn("r", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).withColumn("_corrupt", F.coalesce("r._corrupt", F.when(F.col("r").isNull() | ~F.ltrim("value").startswith("{"), F.col("value"))))


def _first_bad_line(spark: SparkSession, path: str, schema: str) -> str:
    """File, number and begin of the first line that is no object of the schema. Row ids rise with the place in a single file."""
    rows = _parsed(spark.read.text(path).withColumn("__id", F.monotonically_increasing_id()), schema)
    bad = rows.filter("_corrupt IS NOT NULL AND trim(value) <> ''").agg(F.min(F.struct("__id", "value")).alias("b")).first()["b"]
    number = rows.filter(F.col("__id") < bad["__id"]).count() + 1
    return f"{path.rsplit('/', 1)[-1]}:{number}: not an object of the schema: {bad['value'][:100]}"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, mode: str = "strict", defaults: dict | None = None) -> DataFrame:
    """One object a line. ``strict``: a line that is none, or ill-typed, is an error that names its file, number and text; ``lenient``: it is left out.

    Only the fields of the schema are kept; those that a line lacks get their default. Empty lines are left out. Paths must exist.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file")).filter(F.trim("value") != "")
    rows = _parsed(lines, schema)
    if mode == "strict":
        bad = rows.filter("_corrupt IS NOT NULL").select("_file", "value").head(1)
        if bad:
            raise ValueError(_first_bad_line(spark, bad[0]["_file"], schema))
    out = rows.filter("_corrupt IS NULL").select(*[F.col(f"r.`{f.name}`") for f in T.StructType.fromDDL(schema).fields])
    return out.fillna(defaults) if defaults else out


def prediction_rows(raw: DataFrame) -> DataFrame:
    """``index, deceptive, score`` of text columns, and the flags ``repeated, bad_deceptive, bad_score, out_of_range`` of each row."""
    missing = {"index", "deceptive", "score"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    word = F.lower(F.trim(F.col("deceptive").cast("string")))
    decided = F.when(word.isin(_TRUE), 1).when(word.isin(_FALSE), 0)
    score = F.col("score").cast("string").try_cast("double")
    rows = raw.select(F.col("index").cast("string").try_cast("long").alias("index"), decided.alias("deceptive"), F.when(~F.isnan(score), score).alias("score"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("index")) > 1
    bad = F.col("score").isNull()
    return rows.select("*", twice.alias("repeated"), F.col("deceptive").isNull().alias("bad_deceptive"), bad.alias("bad_score"), (~bad & ~F.col("score").between(0, 1)).alias("out_of_range"))


def load_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, ``rule, violations``) of a CSV with a header; callers that are strict fail on any violation."""
    rows = prediction_rows(spark.read.option("header", True).csv(path))
    flags = ["repeated", "bad_deceptive", "bad_score", "out_of_range"]
    counts = rows.agg(*[F.count_if(f).alias(f) for f in flags])
    return rows.filter(" AND ".join(f"NOT {f}" for f in flags)).select("index", "deceptive", "score"), counts.unpivot([], flags, "rule", "violations")


def load_labels(spark: SparkSession, uri: str, label_col: str, id_col: str = "index") -> DataFrame:
    """``index, label`` of a Parquet folder or a ``.csv``; without the id column of Parquet the 0-based place in the order of its files."""
    csv = uri.endswith(".csv")
    raw = spark.read.option("header", True).csv(uri) if csv else spark.read.parquet(uri)
    if label_col not in raw.columns:
        raise ValueError(f"labels lack the column {label_col}")
    label = F.col(label_col).cast("int").alias("label")
    if id_col in raw.columns:
        return raw.select(F.col(id_col).alias("index"), label)
    if csv:
        raise ValueError("a CSV has no row places; give it an id column")
    rows = raw.select("_metadata.file_path", "_metadata.row_index", label)
    sizes = rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("file_path")) - F.col("n"))  # one row a file
    return rows.join(starts, "file_path").select((F.col("start") + F.col("row_index")).alias("index"), "label")


def scan_category(spark: SparkSession, root: str, category: str) -> DataFrame:
    """``sample_id, index, label`` and the other columns of a category's Parquet; the label may be ``deceptive`` or ``dishonest``, the index ``index`` or ``Unnamed: 0``."""
    raw = spark.read.option("mergeSchema", True).parquet(f"{root}/{category}")
    pick = lambda names: next((n for n in names if n in raw.columns), None)
    label, index = pick(["deceptive", "dishonest"]), pick(["index", "Unnamed: 0"])
    if not label or not index:
        raise ValueError(f"{category}: no label or index column")
    rest = [F.col(f"`{c}`") for c in raw.columns if c not in (label, index)]
    key = F.col(f"`{index}`")
    return raw.select(F.concat_ws(":", F.lit(category), key.cast("string")).alias("sample_id"), key.alias("index"), F.col(label).cast("int").alias("label"), *rest)


def scan_keyed_csv(spark: SparkSession, folder: str, pattern: str, required: list[str], key: list[str]) -> DataFrame:
    """All files of a pattern with ``dataset`` from their stem (``a__b`` is ``a/b``); a missing column or a repeated (dataset, key) is an error."""
    raw = spark.read.option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).csv(folder)
    missing = set(required) - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)\.[^.]*$", 1)
    out = raw.select(F.replace(stem, F.lit("__"), F.lit("/")).alias("dataset"), *required)
    if not out.groupBy("dataset", *key).count().filter("count > 1").isEmpty():
        raise ValueError("a key comes twice")
    return out


def union_sources(specs: list[tuple[DataFrame, str | None, float]], key: list[str], strata: list[str], seed: str = "sources") -> DataFrame:
    """Caches under one another, each with its filter (SQL, or None) and stratified fraction; a key found in two of them is an error."""
    parts = []
    for df, condition, fraction in specs:
        kept = df.filter(condition) if condition else df
        parts.append(sample_fraction(kept, fraction, strata, seed) if fraction < 1 else kept)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if not out.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError("a key comes from two sources")
    return out


def write_artifact(df: DataFrame, path: str, fmt: str = "json", partition_by: list[str] | None = None) -> None:
    """Write or replace an artifact; the commit protocol writes beside it and renames at the end."""
    out = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        out = out.option("header", True)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def append_results(df: DataFrame, path: str) -> None:
    """Add records to the ledger; its files are never changed."""
    df.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All records of the ledger; lines of older forms get NULL in what they lack, lines that are no records are left out."""
    return read_jsonl(spark, path, schema, "lenient")


def scan_rows(df: DataFrame, wanted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns asked for, of the keys asked for; only they reach the scan."""
    return df.select(key, *columns).join(wanted.select(key).distinct(), key, "left_semi")
