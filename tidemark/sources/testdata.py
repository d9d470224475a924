"""The canonical event log (run_id, pos, kind, category, api, target, ts, size) from the driver's events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How the driver's event types stand for file events.
KINDS = {"view": "read", "click": "write", "purchase": "move", "error": "delete", "signup": "execute"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event; pos is its place in its run, ts its time in microseconds."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.row_number().over(order).cast("long").alias("pos"),
        kind.alias("kind"),
        F.col("event_type").alias("category"),
        F.concat_ws("_", "event_type", k % 5).alias("api"),
        (k % 10).alias("target"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("value").alias("size"),
        "event_id",
    )


#: The same log in DuckDB, as the start of a WITH clause.
EVENT_LOG_SQL = """WITH ev AS (
SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
 CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'purchase' THEN 'move' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'execute' END AS kind,
 event_type AS category, event_type || '_' || CAST(k % 5 AS VARCHAR) AS api, k % 10 AS target, epoch_us(ts) AS ts, value AS size, event_id
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))
"""
