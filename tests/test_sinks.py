"""Sinks, streams and pictures."""

import datetime

import numpy as np

from tidemark.sources import sinks
from tidemark.streaming import events


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    sinks.write_csv(df, str(tmp_path / "csv"), ["b", "c", "a"])
    back = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert back.columns == ["b", "c", "a"] and {tuple(r) for r in back.collect()} == {(None, None, "1"), ("x", None, "2")}
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    folder = str(tmp_path / "v")
    assert sinks.read_versioned(spark, folder) is None
    sinks.upsert_parquet(df, folder, "a")
    sinks.upsert_parquet(spark.createDataFrame([(2, "y"), (3, "z")], "a long, b string"), folder, "a")
    assert {tuple(r) for r in sinks.read_versioned(spark, folder).collect()} == {(1, None), (2, "y"), (3, "z")}


def test_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    schema = "run_id long, kind string, ts timestamp"
    spark.createDataFrame([(1, k, at(s)) for k, s in (("read", 0), ("write", 1), ("delete", 2), ("write", 11))] + [(2, "read", at(50))], schema).write.parquet(str(tmp_path / "in"))
    counts = events.window_counts(events.event_stream(spark, str(tmp_path / "in"), schema), "10 seconds", "1 second")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    events.upserts(counts, out, check).awaitTermination()
    found = lambda: {(r.run_id, r.start.second, r.n, r.chain) for r in events.latest(spark, out, ["run_id", "start"]).collect()}
    assert found() == {(1, 0, 3, True), (1, 10, 1, False)}
    spark.createDataFrame([(1, "read", at(55)), (3, "read", at(59) + datetime.timedelta(minutes=1))], schema).write.mode("append").parquet(str(tmp_path / "in"))
    counts = events.window_counts(events.event_stream(spark, str(tmp_path / "in"), schema), "10 seconds", "1 second")
    events.upserts(counts, out, check).awaitTermination()
    assert found() == {(1, 0, 3, True), (1, 10, 1, False), (2, 50, 1, False), (1, 50, 1, False)}  # earlier windows of a run stay


def test_latest_rows_win(spark, tmp_path):
    for number, rows in ((0, [(1, 0, "a"), (1, 1, "b")]), (10, [(1, 1, "c"), (2, 0, None)]), (9, [(1, 1, "x")])):
        spark.createDataFrame(rows, "run_id int, start int, v string").write.parquet(str(tmp_path / f"t/batch={number}"))
    assert {tuple(r) for r in events.latest(spark, str(tmp_path / "t"), ["run_id", "start"]).collect()} == {(1, 0, "a"), (1, 1, "c"), (2, 0, None)}
