"""Shared pieces of the corpus operators: tables, the shared folder, bounded filters, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits a key in a filter that `bounded_filter` broadcasts, and words of 64 bits that it has at most (rows of two longs).
FILTER_BITS, FILTER_WORDS = 16, 1 << 19
#: Keys that `join_counted` broadcasts at most.
HOT_ROWS = 50_000
#: Rows of a written file, and files of a written table at least, where its size is known beforehand.
ROWS_A_FILE, FILES = 200_000, 12

_open: ContextVar[list[str] | None] = ContextVar("_open", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. A local session, where they are one process,
    gets a temporary one where it is unset; a cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation.

    most: a number of rows that `df` does not exceed, if known; then it gets a file for each `ROWS_A_FILE` of them, and
    `FILES` at least, however many partitions the shuffle before it had.
    """
    path = own_path(spark, name)
    (df if most is None else df.coalesce(max(FILES, most // ROWS_A_FILE))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; inside `scratch` the folder is deleted at the end."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    if (own := _open.get()) is not None:
        own.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables `written` inside are deleted at the end. What outlives it must be written outside of it."""
    token = _open.set([])
    try:
        yield
    finally:
        paths = _open.get()
        _open.reset(token)
        for path in paths:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator wrote itself in the shared folder, and nothing else."""
    if not path.startswith(f"{shared_dir(spark)}/tidemark/"):
        raise ValueError(f"not one of the operators' own folders: {path}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession, build: Callable[[], DataFrame], name: str, most: int | None = None) -> DataFrame:
    """The DataFrame that `build` returns, `written`; the tables that it wrote on the way are deleted."""
    outer = _open.get()
    with scratch(spark):
        df = build()
        token = _open.set(outer)
        try:
            return written(spark, df, name, most)
        finally:
            _open.reset(token)


def bounded_filter(rows: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """`rows` with a boolean `maybe`: false only where `key` is surely in none of the rows of `keys` (one long column `key`).

    The keys become a bitmap of `FILTER_BITS` bits a key and `FILTER_WORDS` words at most, whatever the input's size.
    `keys` is counted first, so it had better be a written table. A full bitmap saves nothing and loses nothing: whoever
    uses `maybe` still checks exactly.
    """
    words = max(1024, min(FILTER_WORDS, 1 << (keys.count() * FILTER_BITS // 64).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(words * 64))
    bitmap = (
        keys.select(bit(F.col("key")).alias("b"))
        .groupBy(F.expr("b div 64").alias("_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("_bits"))
    )
    out = rows.withColumn("_bit", bit(key)).withColumn("_word", F.expr("_bit div 64"))
    out = out.join(F.broadcast(bitmap), "_word", "left")  # FILTER_WORDS rows at most
    maybe = F.coalesce(F.expr("(shiftright(_bits, cast(_bit % 64 as int)) & 1L) = 1L"), F.lit(False))
    return out.withColumn("maybe", maybe).drop("_word", "_bit", "_bits")


def join_counted(rows: DataFrame, answers: DataFrame, key: str, total: int, how: str = "inner", least: int = 1_000) -> DataFrame:
    """`rows` joined with `answers` (one row per key, with `_n`, the rows of that key; all of them add up to `total`).

    Keys with a share of the rows that could burden one task are joined from a broadcast table. They are so frequent that
    there are `HOT_ROWS` of them at most; all others go through a shuffle. `answers` is looked through for such keys first,
    so it had better be a written table. `how`: inner or left.
    """
    hot = F.col("_n") >= max(least, total // HOT_ROWS)
    if total < least or answers.filter(hot).isEmpty():
        return rows.join(answers.drop("_n"), key, how).select(*rows.columns, *[c for c in answers.columns if c not in (key, "_n")])
    columns = [c for c in answers.columns if c not in (key, "_n")]
    few = answers.filter(hot).select(key, F.struct(*columns).alias("_hot"))
    out = rows.join(F.broadcast(few), key, "left")
    done = out.filter("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in columns])
    rest = out.filter("_hot is null").drop("_hot").join(answers.filter(~hot).drop("_n"), key, how)
    return done.unionByName(rest.select(*rows.columns, *columns))


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives the memory of its task back to the system at the end: workers live on for
    other tasks and operators, and the allocators would keep what they have freed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def released() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of an Arrow batch with about `most` bytes of text each, and their texts with nulls as empty."""
    n, start = batch.num_rows, 0
    if not n:
        return
    texts = batch.column(column)
    ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())).to_numpy(zero_copy_only=False)
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(ends.searchsorted(before + most, "right")))
        part = batch.slice(start, stop - start)
        yield part, pc.fill_null(part.column(column), "")
        start = stop


def numbered(docs: DataFrame, doc_id: str) -> DataFrame:
    """`docs` with a column `_row`: doc_id where each row has its own, else the row's place in the order of doc_id (rows
    with one id in some order, null last), written down so that it stays."""
    if docs.groupBy(F.col(doc_id).alias("_id")).count().filter("count > 1 OR _id IS NULL").isEmpty():
        return docs.withColumn("_row", F.col(doc_id).cast("long"))
    placed = docs.orderBy(F.col(doc_id).asc_nulls_last()).withColumn("_row", F.monotonically_increasing_id())
    return written(docs.sparkSession, placed, "rows")


def plain_docs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
