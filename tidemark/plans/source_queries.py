"""Queries that write files from the driver's tables under the shared folder, read them back with the sources, and delete
them: logs, large binaries, CSV, JSON lines, batches with a commit log; and pictures made of an events table's numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import images
from tidemark.operators.ranks import numbered
from tidemark.plans.registry import query
from tidemark.sources import executables, reports, sinks
from tidemark.sources.shared import Scratch
from tidemark.sources.testdata import EVENT_LOG_SQL as EV
from tidemark.sources.testdata import event_log, table


@query(
    "s10_log_lines",
    EV + """, l AS (SELECT event_id, run_id % 7 AS log, row_number() OVER (PARTITION BY run_id % 7 ORDER BY ts, event_id) AS rn, CASE WHEN kind IN ('read', 'write') THEN ts END AS own FROM ev),
p AS (SELECT *, CAST(greatest(0, 3 - (rn - 1) // 40) AS BIGINT) AS rotation, last_value(own IGNORE NULLS) OVER (PARTITION BY log ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts FROM l)
SELECT event_id, CAST(log AS VARCHAR) AS log, rotation, row_number() OVER (PARTITION BY log, rotation ORDER BY rn) - 1 AS line, ts FROM p""",
)
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rotated logs of seven writers; lines without a time have that of the last line before, in this file or an older
    one."""
    own = Scratch(spark)
    path = own.path("logs")
    events = event_log(spark, sf).withColumn("log", F.col("run_id") % 7)
    placed = numbered(events, ["log"], ["ts", "event_id"], F.floor(F.col("ts") / 3_600_000_000).cast("long"), "rn")
    rotation = F.greatest(F.lit(0), 3 - F.floor((F.col("rn") - 1) / 40)).cast("int")
    stamp = F.concat(F.date_format(F.timestamp_micros("ts"), "yyyy-MM-dd HH:mm:ss,SSSSSS"), F.lit(" "))
    line = F.concat(F.when(F.col("kind").isin("read", "write"), stamp).otherwise("  "), F.lit("event "), F.col("event_id"))
    lines = placed.select("log", rotation.alias("rotation"), "rn", line.alias("value"))
    lines.repartition("log", "rotation").sortWithinPartitions("log", "rotation", "rn").select("log", "rotation", "value").write.partitionBy("log", "rotation").text(path)
    of = lambda name: F.regexp_extract("path", rf"/{name}=(\d+)/", 1)
    found = reports.log_lines(spark, path, log=of("log"), rotation=of("rotation").cast("long"))
    event = F.regexp_extract("text", r"event (\d+)$", 1).cast("long")
    return own.last(found.select(event.alias("event_id"), "log", of("rotation").cast("long").alias("rotation"), "line", F.unix_micros("ts").alias("ts")), "lines")


@query(
    "s08_printable_runs",
    """WITH r AS (SELECT source, unnest(regexp_extract_all(text, '[\\x20-\\x7e]{5,}')) AS run FROM documents)
SELECT source, count(*) AS runs, CAST(sum(length(run)) AS BIGINT) AS characters, CAST(max(length(run)) AS BIGINT) AS longest, min(run) AS least FROM r GROUP BY source""",
)
def printable_runs(spark: SparkSession, sf: str) -> DataFrame:
    """All texts of a source as the bytes of a few large files, and the printable runs in them."""
    own = Scratch(spark)
    path = own.path("binaries")
    table(spark, sf, "documents").filter("text is not null and source is not null").select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    found = reports.printable_runs(spark, path).withColumn("source", F.regexp_extract("path", r"/source=([^/]+)/", 1))
    n = F.length("run")
    return own.last(found.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.sum(n).cast("long").alias("characters"), F.max(n).cast("long").alias("longest"), F.min("run").alias("least")), "runs")


@query(
    "s04_csv_table",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS c_mktsegment, CAST(NULL AS VARCHAR) AS missing FROM customer",
)
def csv_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table with fixed columns, written and appended to, read with columns that it may not have."""
    own = Scratch(spark)
    path, rows = own.path("csv"), table(spark, sf, "customer")
    rows = rows.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    for part, mode in ((0, "error"), (1, "append")):
        sinks.write_csv(rows.filter(F.col("c_custkey") % 2 == part), path, ["c_custkey", "c_name", "c_mktsegment"], mode)
    return own.last(reports.csv_table(spark, path, ["c_custkey", "c_name", "c_mktsegment", "missing"]), "table")


@query("s06_sequences", "SELECT CAST(o_custkey AS VARCHAR) AS run_id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sequence FROM orders GROUP BY o_custkey")
def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences as JSON lines."""
    own = Scratch(spark)
    path = own.path("sequences")
    found = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("run_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("sequence"))  # five priorities
    sinks.write_jsonl(found, path)
    return own.last(reports.sequences_table(spark, path).select("run_id", F.array_join("sequence", ",").alias("sequence")), "sequences")


@query(
    "k07_resumed_batches",
    """WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS digest, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS batch FROM documents),
f AS (SELECT *, min(doc_id) FILTER (batch = 0) OVER (PARTITION BY digest) AS old, min(doc_id) FILTER (batch = 1) OVER (PARTITION BY digest) AS new FROM d)
SELECT doc_id, CAST(batch AS BIGINT) AS batch, CASE WHEN batch = 0 THEN nullif(old, doc_id) ELSE coalesce(old, nullif(new, doc_id)) END AS earlier FROM f""",
)
def resumed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """K4 and K7: a third of the documents committed, a run that ended before its mark, then all of them, and the texts that
    were known under another id when their batch was written."""
    own = Scratch(spark)
    folder = own.path("batches")
    rows = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    known = own.written(sinks.write_batch(rows.filter("doc_id % 3 = 0"), folder, "doc_id", "digest"), "known")
    rows.filter("doc_id % 3 = 1").write.parquet(f"{folder}/parts/batch={1:020d}")  # parts without a log
    for _ in range(2):
        known = known.unionByName(own.written(sinks.write_batch(rows, folder, "doc_id", "digest"), "known"))
    batches = sinks.commit_log(spark, folder, "doc_id long, digest string").select("batch").distinct()
    first = batches.agg(F.min("batch").alias("first"))
    found = sinks.committed(spark, folder).crossJoin(first)  # one row
    return own.last(found.join(known.select("doc_id", "earlier"), "doc_id", "left").select("doc_id", (F.col("batch") != F.col("first")).cast("long").alias("batch"), "earlier"), "resumed")


#: Which cells of a shot differ from the first one, as an expression for both engines; every seventh shot is blank.
DIFFERS = "shot > 0 AND shot % 7 <> 6 AND (run_id * 7 + shot * 3 + gx * 5 + gy * 11) % (shot % 5 + 2) = 0"


@query(
    "o34_screen_change",
    EV + f""", s AS (SELECT run_id, pos - 1 AS shot, count(*) OVER (PARTITION BY run_id) AS n FROM ev WHERE pos <= 2 + run_id % 30),
k AS (SELECT * FROM s WHERE shot > 0 AND shot % 7 <> 6 AND (n - 1 <= 20 OR shot = n - 1 OR (ceil((shot - 1) / ((n - 1) / 20.0)) < 19 AND floor(ceil((shot - 1) / ((n - 1) / 20.0)) * ((n - 1) / 20.0)) = shot - 1))),
c AS (SELECT k.run_id, shot, icons, count(*) AS usable, count(*) FILTER ({DIFFERS}) AS changed FROM k, (SELECT unnest(range(16)) AS gx), (SELECT unnest(range(12)) AS gy), (SELECT unnest([true, false]) AS icons)
 WHERE NOT (gy * 10 >= 120 - 48 OR (gx * 6 >= 57 AND gy * 10 >= 79) OR (icons AND (gx * 6 >= 32 OR gy * 10 >= 109))) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id, icons ORDER BY changed / usable DESC, shot) AS rn FROM c),
r AS (SELECT DISTINCT run_id, n, icons FROM s, (SELECT unnest([true, false]) AS icons))
SELECT CAST(r.run_id AS VARCHAR) AS run_id, r.icons, r.n AS n_shots, changed AS cells_changed, usable AS cells_usable, round(changed / usable, 4) AS cell_change_fraction, round(changed / usable, 4) AS pixel_change_fraction,
 CASE WHEN r.n < 2 THEN 'unknown' WHEN usable IS NULL THEN 'unreadable' WHEN changed / usable >= 0.1 THEN 'yes' ELSE 'no' END AS visual_change, CAST(shot AS VARCHAR) AS peak_shot
FROM r LEFT JOIN (SELECT * FROM b WHERE rn = 1) x ON x.run_id = r.run_id AND x.icons = r.icons""",
)
def screen_change(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures of 96 by 120 pixels whose cells follow from the run's number and the event's place, with the icons'
    region alone and with all but the masks."""
    shots = event_log(spark, sf).filter("pos <= 2 + run_id % 30").select("run_id", (F.col("pos") - 1).alias("shot"))
    cell = f"if({DIFFERS}, 'FF2010', '001020')"
    row = f"array_join(transform(sequence(0, 15), gx -> repeat({cell}, 6)), '')"
    pixels = F.expr(f"unhex(array_join(transform(sequence(0, 11), gy -> repeat({row}, 10)), ''))")
    pictures = shots.select("run_id", "shot", F.col("shot").alias("place"), F.lit(120).alias("height"), F.lit(96).alias("width"), pixels.alias("rgb"))
    parts = [images.screen_change(pictures, icons=icons).withColumn("icons", F.lit(icons)) for icons in (True, False)]
    return parts[0].unionByName(parts[1])


def _little(*numbers: tuple[int, int]) -> str:
    """Numbers of so many bytes, as hexadecimal text with the lowest byte first."""
    return b"".join(n.to_bytes(size, "little") for n, size in numbers).hex()


def _headers() -> str:
    """Everything before the names of an executable with one section at 0x1000, in 512 bytes, and its import directory: one
    library at 0x1040, and in its table a name at 0x1060, a number, and a name at 0x10A0."""
    first = "4d5a" + "00" * 58 + _little((64, 4))
    header = "50450000" + _little((0x14C, 2), (1, 2), (0, 12), (224, 2), (0, 2))
    optional = _little((0x10B, 2), (0, 58), (512, 4), (0, 28), (16, 4), (0, 8), (0x1000, 4), (224, 4)) + "00" * 112
    section = _little((0, 8), (0x400, 4), (0x1000, 4), (0x400, 4), (512, 4), (0, 16))
    whole = first + header + optional + section
    directory = _little((0x1028, 4), (0, 8), (0x1040, 4), (0x1028, 4), (0, 20))
    return whole + "00" * (512 - len(whole) // 2) + directory + _little((0x1060, 4), (0x80000005, 4), (0x10A0, 4), (0, 12))


@query(
    "s07_import_table",
    """WITH p AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'no executable' WHEN p_partkey % 7 = 0 THEN 'outside of the file' END AS error FROM part)
SELECT p_partkey, 0 AS place, CASE WHEN error IS NULL THEN 'lib' || (p_partkey % 10) || '.dll' END AS dll, CASE WHEN error IS NULL THEN p_brand END AS name, error FROM p
UNION ALL SELECT p_partkey, 1, 'lib' || (p_partkey % 10) || '.dll', p_type, NULL FROM p WHERE error IS NULL""",
)
def import_table(spark: SparkSession, sf: str) -> DataFrame:
    """The names that executables import, made of the parts' columns; some are cut off, and some are none."""
    slot = lambda text, n: F.rpad(F.encode(text, "UTF-8"), F.lit(n), F.lit(b"\0"))
    hint, key = F.unhex(F.lit("0000")), F.col("p_partkey")
    library = F.concat(F.lit("lib"), key % 10, F.lit(".dll"))
    whole = F.concat(F.unhex(F.lit(_headers())), slot(library, 32), hint, slot(F.col("p_brand"), 62), hint, slot(F.col("p_type"), 62), F.unhex(F.lit("00" * 800)))
    content = F.when(key % 11 == 0, F.encode(F.lit("#!/bin/sh"), "UTF-8")).when(key % 7 == 0, F.substring(whole, 1, 100)).otherwise(whole)
    # The table is a small file where its executables are not, so its rows are dealt out before these are made of them.
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    found = executables.import_tables(parts.select(key.cast("string").alias("path"), content.alias("content")))
    return found.select(F.col("path").cast("long").alias("p_partkey"), F.col("place").cast("int").alias("place"), "dll", "name", "error")
