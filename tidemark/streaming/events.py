"""Streaming forms of per-run operators, and idempotent writing of batches. An addition: batch queries need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of an event log (run_id, kind, ts as a timestamp, ...)."""
    return spark.readStream.schema(schema).parquet(path)


def window_counts(log: DataFrame, width: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Tumbling windows per run by the clock: kinds of event seen, and whether all of a chain were. State is dropped once
    the watermark has passed; events later than `late` do not count."""
    flag = lambda *k: F.max(F.col("kind").isin(*k).cast("int")) == 1
    per = log.withWatermark("ts", late).groupBy("run_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), flag("read").alias("r"), flag("write").alias("w_"), flag("delete", "move").alias("x"))
    return per.select("run_id", F.col("w.start").alias("start"), "n", (F.col("r") & F.col("w_") & F.col("x")).alias("chain"))


def upserts(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch as a part of its own, named by its number: a batch that is seen twice replaces itself, and
    no batch rewrites what is there. `latest` reads the table that the parts make up."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Of the rows of all batches in a folder of `upserts`, the last one of each key. Rows are aggregated, not sorted."""
    rows = spark.read.parquet(folder)
    columns = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("_r")).select(*keys, "_r.*")
