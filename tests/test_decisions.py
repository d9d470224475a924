"""Cascades, look-ups and manifest steps, by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ((None, True, 0, 2, 5), "STAT_ERROR"),
        ((0, True, 0x2000, 2, 5), "EMPTY_FILE"),
        ((52428800, True, 0, 2, 5), "OK"),
        ((52428801, True, 0, 2, 5), "OVERSIZE"),
        ((9, False, None, None, None), "NOT_PE"),
        ((9, None, None, None, None), "NOT_PE"),
        ((9, True, 0x2002, 1, 0), "DLL"),
        ((9, True, 0x1000, 2, 5), "DRIVER_OR_NATIVE"),
        ((9, True, 2, 1, 0), "DRIVER_OR_NATIVE"),
        ((9, True, 2, 3, 0), "NO_ENTRY_POINT"),
    ],
)
def test_header(spark, row, want):
    df = spark.createDataFrame([row], "size long, parses boolean, flags int, subsystem int, entry long")
    decision, reason = decisions.header_decision(F.col("size"), F.col("parses"), F.col("flags"), F.col("subsystem"), F.col("entry"))
    assert tuple(df.select(reason, decision).first()) == (want, "SUBMIT" if want == "OK" else "SKIP")


def test_best_asset(spark):
    names = ["a-setup.exe", "b-setup.exe", "c.MSI", "big-arm64.msi", "big-portable.exe", "x.zip.exe", "tiny.exe", "huge.exe", "y.deb"]
    sizes = [200_000, 300_000, 300_000, 9e6, 9e6, 9e6, 99_999, 2e8, 9e6]
    df = spark.createDataFrame([("r", i, n, float(s)) for i, (n, s) in enumerate(zip(names, sizes, strict=True))], "repo string, i int, name string, size double")
    assert [r.name for r in decisions.best_asset(df, "repo", "name", "size", 100, "i").collect()] == ["b-setup.exe"]


def test_retry_order(spark):
    cases = [(("truncated", False, 500, True), "RETRY"), (("no_log", True, 100, False), "NO_RETRY"), (("clean", True, 99, False), "RETRY"), (("sample_launch_failed", False, 0, False), "NO_RETRY"), (("no_log", False, None, False), "RETRY"), (("truncated", False, 3, None), "RETRY"), ((None, None, None, None), "NO_RETRY")]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, outcome string, oom boolean, calls long, died boolean")
    decision, _ = decisions.retry_decision(F.col("outcome"), F.col("oom"), F.col("calls"), F.col("died"))
    assert [r[1] for r in df.select("i", decision).orderBy("i").collect()] == [w for _, w in cases]


def test_intents_and_fingerprints(spark):
    rows = spark.createDataFrame([("H1", 0.9), ("H2", 0.1), ("H3", 0.5), ("H4", 1.0)], "sample_id string, flag_rate double")
    names = spark.createDataFrame([(1, "m7_wipe.exe"), (2, "tool_cipher"), (3, "nothing")], "task_id int, variant string")
    found = decisions.intents(rows, names)
    assert {r.sample_id: r.intent for r in found.collect()} == {"H1": "destroys", "H2": "invisible", "H3": "unclassified", "H4": "unclassified"}
    assert {tuple(r) for r in decisions.failures(found, "flag_rate", 0.5).collect()} == {("destroys", 1, 1), ("invisible", 1, 0), ("unclassified", 2, 2)}
    text = spark.createDataFrame([("x Rijndael_SIMD y SSLeay",), (None,), ("plain",)], "t string")
    assert [r[0] for r in text.select(decisions.fingerprints(F.col("t"))).collect()] == ["cryptopp;openssl", "", ""]


def test_labels_and_agreement(spark):
    rows = spark.createDataFrame([("A", True), ("A2", False), ("N", True), ("X", False), ("F", True), (None, True), ("A", None)], "label string, hit boolean")
    assert decisions.label_check(rows, "label", F.col("hit")).first().asDict() == {"confirmed": 3, "detected": 1, "missed": 2, "negatives": 2, "flagged": 1, "passes": False}
    pairs = spark.createDataFrame([("TRUE_ENCRYPTION", "yes"), ("FAILED", "no"), ("FAILED", "yes"), ("TRUE_ENCRYPTION", "no"), ("", "yes"), ("FAILED", "unknown"), (None, None)], "v string, c string")
    assert [r[0] for r in pairs.select(decisions.agreement_class(F.col("v"), F.col("c"))).collect()] == ["agree", "agree", "REVIEW: screen changed but verdict says no encryption", "REVIEW: verdict says encryption but screen unchanged", "", "", ""]


def test_manifest_steps(spark):
    manifest = spark.createDataFrame([("a", "pending", ""), ("b", "submitted", "7"), ("c", "submitted", "8")], "sha string, status string, run_id string")
    more = decisions.added(manifest, spark.createDataFrame([("a",), ("d",), ("d",)], "sha string"))
    assert sorted((r.sha, r.status) for r in more.collect()) == [("a", "pending"), ("b", "submitted"), ("c", "submitted"), ("d", "pending")]
    sent = decisions.marked_submitted(more, spark.createDataFrame([("a", "9"), ("zz", "1")], "sha string, run_id string"))
    done = decisions.marked_result(sent, spark.createDataFrame([("b", "good")], "sha string, result string"))
    again = decisions.reset(done, spark.createDataFrame([("8",), ("7",)], "run_id string"))
    assert {r.sha: (r.status, r.run_id, r.result) for r in again.collect()} == {"a": ("submitted", "9", None), "b": ("analyzed", "7", "good"), "c": ("pending", "", None), "d": ("pending", None, None)}


def test_listing_to_manifest(spark):
    listing = spark.createDataFrame([(1, "h1", "x/one.exe", "x64"), (0, "h1", "x/zero.exe", None), (2, " ", "x/b.exe", "x64"), (3, "h2", "x/c.exe", "x64")], "ordinal int, sha256 string, path string, machine string").withColumns({"subsystem": F.lit("GUI"), "is_dll": F.lit("False")})
    out = decisions.manifest_of(listing, spark.createDataFrame([("h1",)], "sha256 string"), "src", F.lit("d")).collect()
    assert [(r.sha256, r.original_filename, r.source, r.status, r.notes) for r in out] == [("h1", "zero.exe", "src", "pending", "arch=;subsystem=GUI;is_dll=False")]


def test_columns_and_listings_in_a_stable_order(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, z int"), spark.createDataFrame([(3, 4, 5)], "y int, k int, z int")
    assert decisions.stable_columns([a, b], ["id", "k"]) == ["id", "k", "z", "y"]
    assert [tuple(r) for r in decisions.stable_union([a, b], ["id", "k"]).orderBy("k").collect()] == [(None, 1, 2, None), (None, 4, 5, 3)]
    files = spark.createDataFrame([(f"r/shots/{n}",) for n in ("10.png", "2.jpg", "x.bmp", "0001.png", "note.txt", "a.JPEG")], "path string")
    assert [r.path.split("/")[-1] for r in decisions.pictures(files).orderBy("shot").collect()] == ["0001.png", "2.jpg", "10.png", "a.JPEG", "x.bmp"]


def test_kill_effect(spark):
    rows = [("1", "f", "TRUE_ENCRYPTION", "full", False, True, 2), ("2", "f", "FAILED", "full", True, False, 1), ("3", "", "FAILED", "full", False, False, 5), ("4", "f", "TRUE_ENCRYPTION", "full", False, True, 0), ("5", "f", "FAILED", "low", True, True, 9)]
    df = spark.createDataFrame(rows, "sample_id string, family string, verdict string, coverage string, agent_died boolean, hit_timeout boolean, kills int")
    got = {r.family: (r.runs, r.positive, r.with_feature, r.with_feature_positive, r.cut_short, r.whole_window, round(r.share, 4)) for r in decisions.kill_effect(df, "kills").collect()}
    assert got == {"f": (3, 2, 2, 1, 1, 1, 0.6667), "(unattributed)": (1, 0, 1, 0, 0, 0, 0.3333)}
