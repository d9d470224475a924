"""Reports in all their shapes, through to tables."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import reports


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("reports")
    first = {
        "info": {"id": 7},
        "malscore": 4.5,
        "detections": [{"family": "Fam"}],
        "target": {"file": {"pe": {"imports": {"k": {"dll": "KERNEL32.dll", "imports": [{"name": "CryptEncrypt"}, {"name": "ReadFile"}]}}}}},
        "CAPE": {"payloads": [{"pe": {"imports": [{"dll": "A.dll", "imports": [{"name": "CryptGenKey"}, {"name": "CryptEncrypt"}]}]}}]},
        "behavior": {
            "enhanced": [{"object": "file", "event": "read", "timestamp": "2024-01-02 03:04:05,678", "data": {"file": "a"}}, {"object": "file", "event": "move", "timestamp": "bad", "data": {"from": "a", "to": "b"}}],
            "processes": [
                {"process_id": 1, "parent_id": 0, "process_name": "x", "environ": {"CommandLine": "cmd /c"}, "calls": [{"api": "A", "category": "c", "timestamp": "2024-01-02 03:04:05,1", "arguments": [{"name": "Buffer", "value": "old"}, {"name": "Buffer", "value": "\\x00\\xff"}]}]},
                {"process_id": 2, "parent_id": 1, "calls": [{"api": "B", "category": "d", "time": 1.5, "arguments": {"Length": "0x10"}}]},
            ],
            "summary": {"executed_commands": ["vssadmin"], "write_files": []},
        },
    }
    (top / "task_7.json").write_text(json.dumps(first))
    with gzip.open(top / "task_12.json.gz", "wt") as f:
        json.dump({"static": {"pe_imports": [{"dll": "B", "imports": [{"name": "send"}]}]}}, f)
    (top / "task_13.json").write_text("{broken")
    return reports.reports(spark, str(top), prefix="h:")


@pytest.fixture(scope="module", params=["tagged", "landed"])
def rows(found, request, tmp_path_factory):
    return reports.tagged(found) if request.param == "tagged" else reports.land(found, str(tmp_path_factory.mktemp("landed") / "r"))


def test_reports(found, rows):
    assert {(r.run_id, r.bad) for r in found.collect()} == {("h:7", False), ("h:12", False), ("h:13", True)}
    assert {(r.run_id, r.bad) for r in reports.runs(rows).collect()} == {("h:7", False), ("h:12", False), ("h:13", True)}
    assert {(r.run_id, r.malscore, r.family) for r in reports.metadata(rows).collect()} == {("h:7", 4.5, "Fam"), ("h:12", None, "unknown")}
    assert [(r.pos, r.kind, r.ts is None, r.file, r.source, r.target) for r in reports.file_events(rows).orderBy("pos").collect()] == [(0, "read", False, "a", None, None), (1, "move", True, None, "a", "b")]
    assert [(r.node, r.parent, r.command_line) for r in reports.processes(rows).orderBy("proc").collect()] == [(1, 0, "cmd /c"), (2, 1, None)]
    calls = reports.api_calls(rows)
    assert [(r.api, r.args, r.ts is not None) for r in calls.orderBy("pos").collect()] == [("A", {"Buffer": "\\x00\\xff"}, True), ("B", {"Length": "0x10"}, True)]
    assert [r.entropy for r in reports.buffer_entropy(calls).orderBy("pos").collect()] == [1.0, None]
    assert [(r.list, r.value) for r in reports.summary(rows, ["executed_commands", "write_files"]).collect()] == [("executed_commands", "vssadmin")]
    row = reports.structure(found).first()
    assert "behavior" in row.schema and abs(row.share - 2 / 3) < 1e-9


def test_static_features(rows):
    names = reports.imports(rows)
    got = {r.run_id: r for r in reports.static_features(rows, names, {"crypto": ["CryptEncrypt", "CryptGenKey"], "net": ["send"]}, ["crypto", "net"]).collect()}
    assert (got["h:7"].total_imports, got["h:7"].imp_crypto, got["h:7"].imp_net, got["h:7"].indicative_categories, got["h:7"].revealed_crypto) == (2, 1, 0, 1, 1)
    assert (got["h:12"].total_imports, got["h:12"].imp_net, got["h:12"].revealed_net) == (1, 1, None)
    static = reports.static_features(rows, names, {"crypto": ["CryptEncrypt"]}, ["crypto"])
    both = {r.run_id: tuple(r)[1:] for r in reports.interaction(static, reports.api_calls(rows), "crypto", F.col("api") == "Z").collect()}
    assert both == {"h:7": (1, 0, 0), "h:12": (0, 0, 1)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_text("2024-01-02 03:04:05,6 start\nmore\n")
    rows = reports.log_lines(spark, str(tmp_path / "log")).orderBy("line").collect()
    assert [(r.line, r.ts is not None) for r in rows] == [(0, True), (1, True)]
    assert reports.csv_table(spark, str(tmp_path / "none.csv"), ["a", "b"]).count() == 0
    (tmp_path / "x.csv").write_text("a,c\n1,2\n3\n")
    assert [tuple(r) for r in reports.csv_table(spark, str(tmp_path / "x.csv"), ["a", "b", "c"]).collect()] == [("1", None, "2"), ("3", None, None)]
    (tmp_path / "s.jsonl").write_text('{"run_id": "1", "sequence": ["a", "b"]}\n')
    assert reports.sequences_table(spark, str(tmp_path / "s.jsonl")).first().sequence == ["a", "b"]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "f").write_bytes(b"\x00hello world\x01abc\xffprintable\x80")
    assert {r.run for r in reports.printable_runs(spark, str(tmp_path / "bin")).collect()} == {"hello world", "printable"}
    assert reports.decoded_buffer("a\\n\\x41\\\\") == b"a\nA\\" and reports.entropy_of(b"") is None and reports.entropy_of(b"aaaa") == 0.0


def test_batches_and_archives(spark):
    listing = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    order = lambda df: [r.path for r in reports.targets(df).orderBy(F.col("number").asc_nulls_last(), "path").collect()]
    assert order(listing("x/10/reports/report.json", "x/9/reports/report.json", "x/stray/reports/report.json", "x/task_1.json.gz")) == ["x/9/reports/report.json", "x/10/reports/report.json"]
    assert order(listing("x/task_1000_report.json.gz", "x/task_100_report.json.gz", "x/task-7.json", "x/other.json", "x/a.txt")) == ["x/task-7.json", "x/task_100_report.json.gz", "x/task_1000_report.json.gz", "x/other.json"]
    raw = spark.createDataFrame([("task_3.json", '{"info": {"id": 5}}'), ("task_4.json", "{}"), ("task_6.json", "nothing")], "path string, value string")
    got = {(r.run_id, r.bad) for r in reports.merged({"a": raw, "b": raw}).collect()}
    assert got == {(p + i, bad) for p in "ab" for i, bad in (("5", False), ("4", False), ("6", True))}


def test_entropy_of_runs(spark):
    calls = spark.createDataFrame([("r", 1, "W", {"Buffer": "\\x00\\xff"}), ("r", 2, "W", {"Buffer": "aaaa"}), ("s", 1, "W", {"Length": "1"})], "run_id string, pos long, api string, args map<string,string>")
    assert {tuple(r) for r in reports.entropy_of_runs(calls).collect()} == {("r", 2, 0.5, 1.0), ("s", 1, None, None)}


def test_reports_are_parsed_once(spark, found, tmp_path):
    plan = reports.tagged(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1
    assert plan.count("Relation [") == 1
    with pytest.raises(FileNotFoundError):
        reports.landed(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("name", ["o21_behaviours", "o30_report_verdict", "o07_report_stages"])
def test_queries_over_reports_read_landed_relations(spark, name):
    """No query parses a report once its table is landed, and each reads the folders of the kinds that it needs."""
    from tidemark.plans import catalog

    sf = "/root/testdata/sf0.001"
    catalog.QUERIES["s01_reports"](spark, sf)
    df = catalog.QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "parseJson" not in plan
    assert "MapInArrow" not in plan
    scans = [x for x in plan.splitlines() if "FileScan" in x and "/reports-" in x]
    assert scans
    assert all("PartitionFilters: [isnotnull(kind" in x for x in scans)


def test_fields_of_odd_reports(spark):
    """What has another type than expected is NULL, a list that is no list of texts is left out, and nothing fails."""
    docs = [
        ("task_1.json", json.dumps({"info": {"id": 1}, "behavior": {"enhanced": "none", "processes": {"a": 1}, "summary": {"keys": [1, "x", None], "count": 3, "empty": []}}, "malscore": "high", "detections": []})),
        ("task_2.json", json.dumps({"behavior": {"processes": [{"process_id": "x", "calls": None}, {"process_id": 4, "calls": [{"arguments": [{"name": None, "value": "1"}, {"value": "2"}]}, {}]}], "enhanced": [{}, None]}, "target": {"file": {"pe": {"imports": {}}}}, "dropped": [{"pe": {}}, None]})),
        ("task_3.json", "[1, 2]"), ("task_4.json", None), ("task_5.json", "{}"),
    ]
    rows = reports.tagged(reports.parsed(spark.createDataFrame(docs, "path string, value string")))
    assert {(r.run_id, r.bad) for r in reports.runs(rows).collect()} == {("1", False), ("2", False), ("3", True), ("4", True), ("5", False)}
    assert {(r.run_id, r.malscore, r.family) for r in reports.metadata(rows).collect()} == {("1", None, "unknown"), ("2", None, "unknown"), ("5", None, "unknown")}
    assert [(r.proc, r.node, r.command_line) for r in reports.processes(rows).orderBy("proc").collect()] == [(0, None, None), (1, 4, None)]
    assert [(r.pos, r.proc, r.api, r.args) for r in reports.api_calls(rows).orderBy("pos").collect()] == [(1 << 32, 1, None, {}), ((1 << 32) + 1, 1, None, {})]
    assert [(r.run_id, r.pos, r.kind) for r in reports.file_events(rows).orderBy("pos").collect()] == [("2", 0, None), ("2", 1, None)]
    assert [(r.list, r.pos, r.value) for r in reports.summary(rows, ["keys", "count", "empty"]).orderBy("pos").collect()] == [("keys", 0, "1"), ("keys", 1, "x"), ("keys", 2, None)]
    assert reports.imports(rows).count() == 0


def test_calls_are_exploded_without_their_section(spark):
    raw = spark.createDataFrame([("1.json", ' {"info": {"id": 1}}'), ("2.json", "[1]"), ("3.json", "{"), ("4.json", None)], "path string, value string")
    found = reports.parsed(raw)
    assert {r.path: r.bad for r in found.select("path", "bad").collect()} == {"1.json": False, "2.json": True, "3.json": True, "4.json": True}
    plan = reports.tagged(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "schema_of_variant" not in plan
    generate = next(line for line in plan.splitlines() if "Generate posexplode(" in line)
    assert "Generate posexplode(members#" in generate
