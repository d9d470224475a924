"""Exact dedup by progressive refinement, with DataFrame functions only.

Pass 1 groups all rows by text length. Pass 2 hashes a prefix, but only of rows whose length occurs twice. Pass 3
hashes the full content, but only of rows whose length and prefix occur twice; equal full hashes make a group. What a
pass learns is written down and reaches the next scan as a bitmap of bounded size (`bounded_filter`), so texts are never
shuffled. Every grouping is partially aggregated before its shuffle. A group's answer goes back to its rows by a join on
the full hash, or from a broadcast table where the group is so large that one task would feel it (`join_counted`); rows
that no longer have a partner stay out of that join, so nothing meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_filter, join_counted, settled, table, written

#: Characters of the prefix that pass 2 hashes.
PREFIX = 256
#: Rows of a group from which its answer may be broadcast.
HOT = 1_000


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id (largest id of the group), group_size, kept, and the columns of `carry`.

    A null text counts as empty; empty texts are equal to each other. Rows that repeat an id count as rows of their
    group, and all rows with the largest id are kept. Rows without an id stay only where their group has no id at all.
    Other columns of `docs` are ignored, whatever their names; an empty table gives no rows.
    """
    return settled(docs.sparkSession, lambda: _exact_groups(docs, doc_id, text, carry), "exact")


def _exact_groups(docs: DataFrame, doc_id: str, text: str, carry: dict[str, Column] | None) -> DataFrame:
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_text"), *[c.alias(f"_carry_{k}") for k, c in (carry or {}).items()])
    thin, groups, total = _refined(spark, rows)
    alone, maybe = thin.filter("_full is null"), thin.filter("_full is not null")
    answered = join_counted(maybe, groups, "_full", total, "left", HOT)
    keep = F.coalesce("keep_id", "doc_id")
    return alone.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1)).unionByName(answered).select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.coalesce("group_size", F.lit(1)) > 1, F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(True).alias("kept"),
        *(F.col(f"_carry_{k}").alias(k) for k in carry or {}),
    )


def _refined(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """`rows` with `_full`, the hash of the text where a partner is possible, else null, and without the text; keep_id,
    group_size and _n of each hash that occurs twice; the number of rows in these groups."""
    rows = rows.withColumn("_len", F.octet_length("_text"))
    lengths = written(spark, rows.groupBy("_len").count().filter("count > 1").select(F.col("_len").cast("long").alias("key")), "lengths")
    first = bounded_filter(rows, lengths, F.col("_len").cast("long")).withColumnRenamed("maybe", "_same_len")
    first = first.withColumn("_prefix", F.when(F.col("_same_len"), F.xxhash64("_len", F.substring("_text", 1, PREFIX))))

    prefixes = first.filter("_prefix is not null").groupBy("_prefix").count().filter("count > 1").select(F.col("_prefix").alias("key"))
    second = bounded_filter(first, written(spark, prefixes, "prefixes"), F.col("_prefix"))
    full = F.when(F.col("_prefix").isNotNull() & F.col("maybe"), F.unhex(F.sha2("_text", 256)))
    thin = second.withColumn("_full", full).drop("_text", "_len", "_prefix", "_same_len", "maybe")

    groups = thin.filter("_full is not null").groupBy("_full").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = written(spark, groups.withColumn("_n", F.col("group_size")), "groups")
    return thin, groups, groups.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of equal texts those with the largest id.

    Rows are told apart by id and text, so a row stays whose id another, dropped text has too. Repeated rows (one id, one
    text) all stay if one does. A null text counts as empty. Texts without a partner never move: only rows whose id may be
    among the dropped ones meet these in a join.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def dropped() -> DataFrame:
        rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_text"))
        thin, groups, total = _refined(spark, rows)
        out = join_counted(thin.filter("_full is not null"), groups, "_full", total, "inner", HOT)
        return out.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.xxhash64("doc_id").alias("key"), F.col("doc_id").alias("_gone"), "_full").distinct()

    gone = settled(spark, dropped, "dropped")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    marked = bounded_filter(docs.toDF(*names), gone.select("key"), F.xxhash64(F.col(names[docs.columns.index(doc_id)])))
    own, digest = F.col(names[docs.columns.index(doc_id)]), F.unhex(F.sha2(F.coalesce(F.col(names[docs.columns.index(text)]).cast("string"), F.lit("")), 256))
    checked = marked.filter("maybe").join(gone, own.eqNullSafe(F.col("_gone")) & (digest == F.col("_full")), "left_anti")
    return marked.filter("not maybe").select(*names).unionByName(checked.select(*names)).toDF(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return exact_groups(docs, carry={"text_sha256": digest})


OP9_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
