"""Hand-derived answers: guards, ties, and NULL against zero."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, safe
from tidemark.operators import behaviour, events, sequences, stats, tables, verdict

S = 1_000_000


def log(spark, rows):
    """(kind, target[, seconds]) in order, of one run."""
    full = [(1, i + 1, r[0], r[0], r[0], r[1], int((r[2] if len(r) > 2 else i) * S), 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "run_id long, pos long, kind string, category string, api string, target string, ts long, size double")


def one(df):
    return {k: round(v, 4) if isinstance(v, float) else v for k, v in df.first().asDict().items()}


def test_set_relations_and_chains(spark):
    rows = log(spark, [("read", "a"), ("write", "a"), ("read", "b"), ("delete", "b"), ("write", "c")])
    assert one(events.set_relations(rows)) == {"run_id": 1, "rw_jaccard": 0.3333, "write_not_read": 0.5, "read_not_write": 0.5, "read_then_destroy": 0.5, "write_then_destroy": 0.0, "rw_size_ratio": 1.0}
    got = one(events.chain_shapes(rows))
    assert (got["n_targets"], got["n_shapes"], got["top_shape_share"]) == (3, 3, 0.3333)
    assert got["chain_read_write"] == got["chain_read_destroy"] == got["chain_write_only"] == 0.3333
    none = one(events.set_relations(log(spark, [("move", "a")])))
    assert none["rw_jaccard"] is None and none["write_not_read"] is None


def test_bigrams(spark):
    rows = log(spark, [("A", "x"), ("B", "x"), ("A", "x"), ("B", "x")]).withColumn("category", F.lit("c"))
    got = one(events.transitions(rows, ["c"], ["d"]))
    assert (got["n_apis"], got["n_bigrams"], got["branching"], got["bigram_entropy"], got["top_bigram_share"], got["switch_rate"]) == (2, 2, 1.0, 0.9183, 0.6667, 0.0)
    assert set(one(events.transitions(log(spark, [("A", "x")]), ["c"], ["d"])).values()) == {1, 0}  # the run, and zeros


def test_latency_pairs(spark):
    rows = log(spark, [("read", "p", 0), ("read", "p", 1), ("write", "p", 3), ("write", "p", 4), ("read", "p", 10), ("write", "p", 11)])
    assert sorted(r.gap for r in events.read_write_pairs(rows).collect()) == [S, 3 * S]
    assert one(events.read_write_latency(rows))["latency_pairs"] is None
    assert one(events.read_write_latency(rows, least=2))["latency_pairs"] == 2


@pytest.mark.parametrize("n", [9, 10])
def test_walk(spark, n):
    rows = log(spark, [("read", d) for d in "xxxyyxxyyy"[:n]])
    got = one(events.walk(rows, F.col("target")))
    want = {"run_id": 1, "walk_same_rate": 0.6667, "walk_switches": 3, "walk_revisit_rate": 0.5, "walk_run_length": 2.5, "walk_places": 2}
    assert got == (want if n == 10 else dict.fromkeys(want) | {"run_id": 1})


def test_decoys(spark):
    rows = log(spark, [("write", "n"), ("read", "d"), ("write", "d"), ("delete", "e"), ("write", "s"), ("delete", "s"), ("read", "q")])
    assert one(verdict.decoy_damage(rows)) == {"run_id": 1, "destroyed_decoys": 2, "self_created": 2, "read_only_decoys": 1}


def test_window_correlation_without_a_grid(spark):
    rows = log(spark, [(k, "t", t) for k, t in (("write", 0), ("delete", 0), ("write", 1), ("write", 5), ("delete", 9), ("read", 30))])
    a, b = F.col("kind") == "write", F.col("kind") == "delete"
    assert one(events.window_correlation(rows, a, b)) == one(events.dense_correlation(rows, a, b, S))
    assert one(events.window_correlation(log(spark, [("write", "a"), ("write", "b")]), a, b))["window_correlation"] is None


def test_statistics(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (0, 2.0), (0, 0.0)], "y int, value double").withColumn("feature", F.lit("f"))
    assert one(stats.auc(rows, ["feature"]))["auc"] == 0.6667
    assert one(stats.auc(rows, ["feature"], 5))["auc"] is None
    for hits, n, want in ((3, 10, (0.3, 0.1078, 0.6032)), (0, 10, (0.0, 0.0, 0.2775)), (0, 0, (None, None, None))):
        assert tuple(one(spark.range(1).select(*[c.alias(k) for k, c in zip("plh", safe.wilson(F.lit(hits), F.lit(n)), strict=True)])).values()) == want
    four = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 4)], "x double")
    assert four.agg(safe.upper_median("x")).first()[0] == 3
    assert four.agg(safe.pearson(F.col("x"), F.lit(1.0))).first()[0] is None


def test_best_of(spark):
    rows = spark.createDataFrame([(0, "k", 1, 900), (1, "k", 5, 100), (2, "k", 5, 100), (3, "", 1, 1), (4, None, 1, 1), (5, " ", 2, 2)], "i long, sha string, r int, n int")
    assert sorted(r.i for r in tables.best_of(rows, F.col("sha"), [F.desc("r"), F.desc("n")], "i").collect()) == [1, 3, 4, 5]


def test_subsequences(spark):
    found = spark.createDataFrame([(1, list("ABC")), (2, list("AC")), (3, list("BA"))], "run_id long, sequence array<string>")
    got = {"".join(r.pattern): r.support_count for r in sequences.frequent_patterns(found, 0.0).collect()}
    assert got == {"A": 3, "B": 2, "C": 2, "AC": 2}


def test_names(spark):
    kind = lambda x: spark.range(1).select(paths.variant_kind(F.lit(x))).first()[0]
    assert kind("xc_D_l200_rand_r3") == "xc_D_rand" and kind("xc_D_l1000_r0") == "xc_D"
    p = spark.createDataFrame([("C:\\a.b\\c",), ("C:\\d\\Report.final.DOCX",), ("x",)], "p string")
    assert [tuple(r) for r in p.select(paths.extension_or_none(F.col("p")), paths.extension(F.col("p")), paths.dotted_suffix(F.col("p")), paths.directory(F.col("p")), paths.stem(F.col("p"))).collect()] == [
        ("(none)", "", "", "C:\\a.b", "C:\\a.b\\c"),
        ("docx", "docx", ".final.docx", "C:\\d", "C:\\d\\Report.final"),
        ("(none)", "", "", "", "x"),
    ]


def test_renames(spark):
    moves = spark.createDataFrame([(1, 1, "a.docx", "a.docx.zz"), (1, 2, "a.dll", "Q.[m]"), (1, 3, "app.log", "app.log.1"), (1, 4, "x.doc", "x.tmp")], "run_id long, pos long, source string, target string")
    none = spark.createDataFrame([], "run_id long, dir string, path string")
    assert one(verdict.append_renames(moves, none, none)) == {"run_id": 1, "append_renames": 2, "distinct_suffixes": 2}
    assert one(verdict.shared_extension(moves)) == {"run_id": 1, "shared_extension_renames": 1, "shared_extension": ".[m]"}
    written, gone = (spark.createDataFrame([(1, "d", p) for p in ps], "run_id long, dir string, path string") for ps in (["f.txt.lock", "g"], ["f.txt", "f"]))
    assert one(verdict.append_renames(moves.limit(0), written, gone)) == {"run_id": 1, "append_renames": 1, "distinct_suffixes": 1}


def test_tree(spark):
    edges = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 1, "b"), (1, 3, 2, "svc"), (1, 4, 3, "c")], "run_id int, node int, parent int, name string")
    assert {r.node for r in tables.tree_closure(edges, F.col("node") == 1, F.col("name") == "svc").collect()} == {1, 2}


EVIDENCE = "destroyed_decoys int, append_renames int, distinct_suffixes int, shared_extension_renames int, note_dirs int, note_explicit boolean, total_calls int, read_only_decoys int"


@pytest.mark.parametrize(
    ("row", "want", "axes"),
    [
        ((3, 0, 0, 0, 0, False, 1, 0), "TRUE_ENCRYPTION", 1),  # damage counts before execution does
        ((2, 0, 0, 0, 0, False, 900, 0), "WEAK_VICTIM_ACTIVITY", 1),
        ((0, 8, 2, 0, 0, False, 900, 0), "TRUE_ENCRYPTION", 1),
        ((0, 10, 3, 0, 0, False, 900, 0), "TRUE_ENCRYPTION", 1),  # exactly 0.3
        ((0, 10, 4, 0, 0, False, 900, 0), "NO_VICTIM_ACTIVITY", 1),  # suffixes differ too much
        ((0, 7, 1, 0, 0, False, 900, 0), "NO_VICTIM_ACTIVITY", 1),
        ((0, 0, 0, 50, 0, False, 900, 0), "TRUE_ENCRYPTION", 1),
        ((0, 0, 0, 49, 0, False, 900, 0), "NO_VICTIM_ACTIVITY", 1),
        ((2, 0, 0, 49, 0, False, 900, 0), "TRUE_ENCRYPTION", 2),  # two axes, neither conclusive
        ((1, 0, 0, 0, 1, False, 900, 0), "TRUE_ENCRYPTION", 2),
        ((0, 0, 0, 0, 1, True, 900, 0), "TRUE_ENCRYPTION", 1),  # a note that states its purpose is enough
        ((0, 0, 0, 0, 1, False, 900, 0), "NO_VICTIM_ACTIVITY", 1),
        ((0, 0, 0, 0, 2, False, 10, 0), "TRUE_ENCRYPTION", 1),
        ((0, 0, 0, 0, 0, False, 499, 9), "FAILED", 0),
        ((0, 0, 0, 0, 0, False, 500, 9), "NO_VICTIM_ACTIVITY", 0),
    ],
)
def test_verdict_boundaries(spark, row, want, axes):
    got = verdict.verdicts(spark.createDataFrame([row], EVIDENCE)).first()
    assert (got.verdict, got.axes) == (want, axes)


def test_note_spread(spark):
    paths_ = [f"C:\\d{i}\\READ_ME.txt" for i in range(3)] + [f"C:/D{i % 2}/How-To.TXT" for i in range(5)] + ["readme.txt"] + [f"C:\\e{i}\\Backup and Restore.lnk" for i in range(9)]
    files = spark.createDataFrame([(1, p) for p in paths_] + [(2, p) for p in paths_ if "READ" in p], "run_id long, path string")
    got = {r.run_id: tuple(r)[1:] for r in verdict.note_spread(files).collect()}
    assert got == {1: (2, "how-to.txt", True, 2), 2: (3, "read_me.txt", False, 1)}
    tie = spark.createDataFrame([(1, "C:\\a\\readme.txt.1"), (1, "C:\\a\\readme.txt"), (1, "C:\\a\\readmf readme")], "run_id long, path string")
    assert verdict.note_spread(tie).first().note_name == "readme.txt"


def test_decoys_by_folder(spark):
    p = lambda *x: "\\".join(("C:", "Users", "Admin", *x))
    rows = spark.createDataFrame([(1, k, f) for k, f in (("write", p("Desktop", "a.docx")), ("delete", p("Desktop", "b.vdfx")), ("move", p("Documents", "Desktop.ini")), ("write", "C:\\x\\a.docx"), ("read", p("Downloads", "c.docx")))], "run_id int, kind string, path string")
    assert one(verdict.decoy_diagnosis(rows, F.col("path"), ["docx"])) == {"run_id": 1, "in_folders": 3, "without_noise": 2, "allowed_only": 1}
    assert [r.kind for r in rows.filter(verdict.is_decoy(F.col("path"))).orderBy("kind").collect()] == ["delete", "read", "write"]


def test_no_column_of_the_verdict_may_predict_it():
    from tidemark.operators import ml

    given = ["destroyed_decoy_files", "append_renames", "ransom_note_dirs", "corroborating_axes", "reason", "malscore", "verdict", "y", "task_id", "destroyed_decoys", "note_dirs", "axes", "n_calls", "imp_crypto"]
    assert ml.usable(given, given) == ["n_calls", "imp_crypto"]


def test_groups_of_extensions(spark):
    got = {e: spark.range(1).select(paths.extension_group(F.lit(e))).first()[0] for e in ("docx", "sqlite", "py", "efi", "iso", "webp", "zz", "")}
    assert got == {"docx": "document", "sqlite": "database", "py": "code", "efi": "executable", "iso": "archive", "webp": "media", "zz": "other", "": "other"}


def test_exclusion_notes_may_hold_quotes(spark):
    manifest = spark.createDataFrame([("a", "pending", "x"), ("b", "pending", None), ("c", "done", "y;")], "k string, status string, notes string")
    held = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    got = {r.k: (r.status, r.notes) for r in tables.exclude(manifest, held, "k", "host's copy").collect()}
    assert got == {"a": ("excluded", "x;host's copy"), "b": ("excluded", "host's copy"), "c": ("done", "y")}


def test_command_rules(spark):
    cases = {
        "vssadmin.exe delete shadows /all": [],
        "wmic shadowcopy delete": ["SHADOW_DELETE"],
        "BCDEDIT /set x & taskkill /f": ["RECOVERY_DISABLE", "PROCESS_KILL"],
        "wbadmin delete catalog": ["BACKUP_DELETE"],
        "netsh advfirewall set allprofiles state off": [],  # the words are too far apart
        "netsh firewall set opmode disable": ["FIREWALL_DISABLE"],
        "wevtutil cl system": ["EVENTLOG_CLEAR"],
        "schtasks /create /tn x": ["PERSIST_SCHTASK"],
        "net  stop x; sc config y": ["SERVICE_ACCESS"],
        'C:\\Users\\a\\AppData\\Roaming\\x.exe': ["SELF_COPY"],
        "notepad": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.t for r in rows.select("text", behaviour.command_tokens(F.col("text")).alias("t")).collect()} == cases


def test_api_rules_merge_classes_and_take_the_first_evidence(spark):
    calls = [("MoveFileW", None, 5 + i) for i in range(12)] + [("NtSetInformationFile", "10", 3 + 100 * i) for i in range(8)] + [("NtSetInformationFile", "13", 2)] * 3 + [("connect", None, None), ("NtTerminateProcess", None, 1), ("NtTerminateProcess", None, 1)]
    rows = spark.createDataFrame([(1, i, a, t, c) for i, (a, c, t) in enumerate(calls)], "run_id int, pos long, api string, ts long, class string")
    got = {r.token: (r.ts, r.pos) for r in behaviour.api_marks(rows).collect()}
    assert got == {"FILE_RENAME": (3, 12), "NETWORK": (1, 23)}  # 12 + 8 renames; a call without a time has the run's start
    marks = behaviour.api_marks(rows).unionByName(spark.createDataFrame([(1, 3, -1, "SHADOW_DELETE"), (1, 9, 0, "NETWORK")], "run_id int, ts long, pos long, token string"))
    assert behaviour.behaviours(marks).first().sequence == ["NETWORK", "SHADOW_DELETE", "FILE_RENAME"]


def test_preparation_timing(spark):
    processes = spark.createDataFrame([(1, "WMIC.exe", 10 * S), (1, "net.exe", 25 * S), (1, "x.exe", 1), (2, "sc.exe", 5 * S), (3, "reg.exe", 40 * S)], "run_id int, name string, ts long")
    destroyed = spark.createDataFrame([(1, 20 * S), (1, 30 * S), (3, 20 * S), (3, 30 * S)], "run_id int, ts long")
    got = {r.run_id: tuple(r)[1:] for r in behaviour.preparation_timing(processes, destroyed).collect()}
    assert got == {1: (2, 2, 1, 1, 10.0, 2, 10.0, 1, 1, 0.5), 2: (1, 1, 0, None, None, None, None, None, None, None), 3: (1, 1, 0, 0, None, 0, 10.0, 0, 0, None)}


def test_attempts(spark):
    rows = spark.createDataFrame([("a;submit_failed_x3",), ("submit_failed_x12;b",), ("b",), (None,)], "notes string")
    assert [tuple(r) for r in rows.select(behaviour.attempts(F.col("notes")), behaviour.without_attempts(F.col("notes"))).collect()] == [(3, "a"), (12, ";b"), (0, "b"), (0, "")]


def test_order_of_rows_plays_no_part(spark):
    rows = log(spark, [("read", "a"), ("write", "b"), ("read", "b"), ("delete", "a"), ("write", "a")])
    for f in (events.set_relations, events.chain_shapes, lambda x: events.read_write_latency(x, least=1)):
        assert one(f(rows)) == one(f(rows.orderBy(F.desc("pos"))))


def test_relational_table_deals_the_log_by_run_once(spark):
    from tidemark.operators import events as ops

    rows = [(r, i, ("read", "write", "delete", "move")[i * r % 4], "f", f"a{i % 3}", i % 5, i * 1_000_000, 1.0) for r in range(1, 6) for i in range(1, 40)]
    log = spark.createDataFrame(rows, "run_id long, pos long, kind string, category string, api string, target long, ts long, size double")
    parts = {"shapes": ops.chain_shapes, "rhythm": ops.rhythm, "sets": ops.set_relations, "few": lambda x: ops.walk(x, F.col("target"), least=30).filter("run_id < 3")}
    out = ops.relational_table(log, parts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    assert "Bucketed: true" in plan
    got = {r.run_id: r for r in out.collect()}
    assert set(got) == set(range(1, 6)) and all(r.n_calls == 39 for r in got.values())
    alone = {r.run_id: r for r in ops.chain_shapes(log).collect()}
    assert all(got[i][f"shapes_{c}"] == alone[i][c] for i in got for c in alone[i].asDict() if c != "run_id")
    walked = [c for c in out.columns if c.startswith("few_")]
    assert walked and all(got[5][c] is None for c in walked)


def test_relational_table_holds_one_part_at_a_time(spark, monkeypatch):
    """No window over the log is left for the task that joins the parts, and buckets follow the log's rows."""
    from tidemark.sources import shared

    monkeypatch.setattr(shared, "BUCKET_ROWS", 20, raising=False)
    rows = [(r, i, "read", "f", f"a{i % 3}", i % 5, i * 1_000_000, 1.0) for r in range(1, 6) for i in range(1, 40)]
    log = spark.createDataFrame(rows, "run_id long, pos long, kind string, category string, api string, target long, ts long, size double")
    out = events.relational_table(log, {"rhythm": events.rhythm, "walk": lambda x: events.walk(x, F.col("target"), least=30)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SelectedBucketsCount: 10 out of 10" in plan
    assert {r.run_id: r.walk_walk_places for r in out.collect()} == dict.fromkeys(range(1, 6), 5)


def test_repeated_keys_do_not_fan_out(spark):
    from tidemark.operators import decisions, stats, tables

    rows = spark.createDataFrame([(1, 7), (2, 8)], "id int, k int")
    names = spark.createDataFrame([(7, "b"), (7, "a"), (9, "c")], "k int, v string")
    assert sorted(map(tuple, tables.first_of(rows, [names], ["k"], "v").select("id", "v").collect())) == [(1, "a"), (2, None)]
    manifest = spark.createDataFrame([("x", "pending", ""), ("y", "pending", "r0")], "sha string, status string, run_id string")
    results = spark.createDataFrame([("x", "FAILED", "r1", 5), ("x", "DONE", "r2", 9), ("y", "DONE", "r3", 1)], "sha string, status string, run_id string, at int")
    assert sorted(map(tuple, tables.write_back(manifest, results, "sha", order="at").collect())) == [("x", "DONE", "r2"), ("y", "DONE", "r0")]
    assert sorted(map(tuple, tables.write_back(manifest, results, "sha").collect())) == [("x", "FAILED", "r1"), ("y", "DONE", "r0")]
    samples = spark.createDataFrame([("H1",), ("H2",)], "sample_id string")
    assert decisions.intents(samples, spark.createDataFrame([(1, "b.exe"), (1, "a")], "task_id int, variant string")).count() == 2
    runs = spark.createDataFrame([("a", "T"), (" a", "F"), ("b", "T"), ("b", "T"), ("c", None), (" ", "T"), (None, "F")], "sha string, verdict string")
    assert tuple(tables.disagreements(runs, F.col("sha"), F.col("verdict")).first()) == (2, 2, 1)
    values = spark.createDataFrame([(1.0, None), (4.0, 2.0), (2.0, None), (3.0, None)], "a double, b double")
    assert {tuple(r) for r in stats.timing_summary(values, ["a", "b"]).collect()} == {("a", 4, 1.0, 2.5, 4.0), ("b", 1, 2.0, 2.0, 2.0)}


def test_a_burst_is_one_equality_join(spark):
    from tidemark.operators import tables

    left = spark.createDataFrame([(i, i % 50) for i in range(300)], "a int, ts long")
    right = spark.createDataFrame([(i, i * 7 % 60) for i in range(80)], "b int, ts long")
    got = sorted((r.a, r.b) for r in tables.near_in_time(left, right, 5).collect())
    assert got == sorted((i, j) for i in range(300) for j in range(80) if abs(i % 50 - j * 7 % 60) <= 5)
