"""Sinks: fixed-schema CSV, JSON lines, patterns with a legend, upserts into versioned Parquet folders, and batches with a
commit log that can be resumed."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tables import upsert


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """The given columns in their order, with a header; NULL is blank and columns that are missing are too."""
    cells = [F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*cells).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_patterns(matrix: DataFrame, patterns: DataFrame, path: str) -> None:
    """The matrix of pattern columns, and beside it which pattern each column is."""
    matrix.write.parquet(f"{path}/matrix")
    patterns.write.parquet(f"{path}/legend")


def read_versioned(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last complete version of a folder that `upsert_parquet` writes; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v=*/_SUCCESS")) or []
    last = max((f.getPath().getParent().toString() for f in found), default=None)
    return spark.read.parquet(last) if last else None


def upsert_parquet(new: DataFrame, folder: str, key: str) -> None:
    """Writes a new version of the folder in which the rows of `new` replace those with their key. A version counts once
    its commit mark is there, so a reader sees the old version or the new one, and nothing is deleted."""
    old = read_versioned(new.sparkSession, folder)
    out = new if old is None else upsert(old, new, key)
    out.write.parquet(f"{folder}/v={time.time_ns():020d}")


def _marked(spark: SparkSession, folder: str) -> list[str]:
    """The batches of a folder of `write_batch` whose log is complete, in their order."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/log/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(f.getPath().getParent().getName() for f in found)


def commit_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Key, digest and batch of every row that is committed. schema: of key and digest, as `write_batch` has them."""
    batches = _marked(spark, folder)
    if not batches:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{folder}/log").parquet(*[f"{folder}/log/{b}" for b in batches])


def committed(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all committed batches, with `batch`; None before the first."""
    batches = _marked(spark, folder)
    return spark.read.option("basePath", f"{folder}/parts").option("mergeSchema", True).parquet(*[f"{folder}/parts/{b}" for b in batches]) if batches else None


def write_batch(rows: DataFrame, folder: str, key: str, digest: str) -> DataFrame:
    """Writes the rows whose key is not committed yet as a batch of its own: first its parts, then its log of keys and
    digests, whose commit mark makes the batch count. Of rows that share a key one is written.

    A run that ends between the two leaves parts that no reader takes; the next run writes these rows again, and runs that
    are repeated write nothing new. Returns the rows of this batch whose digest another key had before (in the log, or a
    lesser key in this batch): key, digest, earlier (that key)."""
    spark, number = rows.sparkSession, time.time_ns()
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, digest))
    log = commit_log(spark, folder, schema)
    todo = rows.join(log.select(F.col(key).alias("_known")), F.col(key).eqNullSafe(F.col("_known")), "left_anti").dropDuplicates([key])
    todo.write.parquet(f"{folder}/parts/batch={number:020d}")
    part = spark.read.schema(rows.schema).parquet(f"{folder}/parts/batch={number:020d}").select(key, digest)
    part.write.parquet(f"{folder}/log/batch={number:020d}")
    before = log.groupBy(digest).agg(F.min(key).alias("_old"))
    least = part.groupBy(digest).agg(F.min(key).alias("_new"))
    earlier = F.coalesce("_old", F.when(F.col(key) != F.col("_new"), F.col("_new")))
    return part.join(least, digest).join(before, digest, "left").select(key, digest, earlier.alias("earlier")).filter("earlier is not null")
