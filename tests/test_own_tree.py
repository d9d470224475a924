"""Own processes, and what counts for them alone, against a plain walk through the tree."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import behaviour, tables


def walk(entries, bystanders=behaviour.BYSTANDERS):
    """The ids that a plain loop keeps, of (proc, node, parent, name)."""
    kept, before = {entries[0][1]}, None
    while kept != before:
        before = set(kept)
        kept |= {node for _, node, parent, name in entries if parent in kept and (name or "").lower() not in bystanders}
    return kept


def test_own_processes(spark):
    rng = random.Random(3)
    names = ["a.exe", "b.exe", "Explorer.EXE", "svchost.exe", None]
    runs = {r: [(i, rng.choice([*range(12), None]), rng.choice([*range(12), None]), rng.choice(names)) for i in range(rng.randint(1, 14))] for r in range(40)}
    runs[90] = [(i, i, i - 1, "a.exe") for i in range(70)]
    runs[91] = [(0, 5, 6, "svchost.exe"), (1, 6, 5, "a.exe"), (2, 7, 8, "a.exe"), (3, 8, 7, "a.exe"), (4, 9, 6, "dwm.exe"), (5, 10, 9, "a.exe")]
    rows = [(r, *e) for r, es in runs.items() for e in es]
    df = spark.createDataFrame(rows, "run_id long, proc int, node long, parent long, name string")
    got = collections.defaultdict(set)
    for r in behaviour.own_processes(df).collect():
        got[r.run_id].add(r.proc)
    assert got == {r: {e[0] for e in es if e[1] in walk(es)} for r, es in runs.items()}
    assert got[91] == {0, 1}
    assert behaviour.own_processes(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [1, 64, 300])
def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch, depth):
    rounds = []
    monkeypatch.setattr(tables.Scratch, "written", lambda self, df, name, put=tables.Scratch.written: rounds.append(name) or put(self, df, name))
    edges = spark.createDataFrame([(r, i, i - 1) for r in range(3) for i in range(depth + 1)], "run_id int, node int, parent int")
    assert tables.tree_closure(edges, F.col("node") == 0, F.lit(False)).count() == 3 * (depth + 1)
    assert len(rounds) <= 2 * (depth.bit_length() + 1) + 1


def test_what_bystanders_do_does_not_count(spark):
    processes = spark.createDataFrame([(1, 0, 10, 1, "s.exe", 5, None), (1, 1, 11, 10, "explorer.exe", 6, "vssadmin shadow delete"), (1, 2, 12, 11, "x.exe", 7, None), (1, 3, 13, 10, "c.exe", 8, None)], "run_id int, proc int, node long, parent long, name string, ts long, text string")
    n = iter(range(10**6))
    call = lambda proc, api, ts, **args: (1, next(n), proc, api, ts, args, None)
    doc = lambda i: f"C:\\U\\f{i}.doc"
    rows = [call(2, "connect", 1), call(2, "NtReadFile", 1, HandleName=doc(0)), call(0, "NtCreateSection", 100, SectionHandle="0x1", FileName="C:\\M"), call(3, "NtMapViewOfSection", 101, SectionHandle="0x1")]
    rows += [call(0, "NtWriteFile", 102, HandleName=doc(0)), call(3, "WriteFile", 103, HandleName="c:\\m"), call(0, "NtReadFile", 104, HandleName=doc(1)), call(3, "NtReadFile", 105, HandleName="\\Device\\x")]
    rows += [call(3, "NtWriteFile", 106, HandleName="c:\\u\\F1.locked"), call(3, "NtWriteFile", 107, HandleName="\\device\\x"), call(2, "NtCreateFile", 2, FileName="c:\\a\\HELP.txt"), call(3, "NtCreateFile", 108, FileName="c:\\b\\HELP.txt")]
    rows += [call(0, "RmStartSession", None)]
    calls = spark.createDataFrame(rows, "run_id int, pos long, proc int, api string, ts long, args map<string,string>, class string")
    own = behaviour.own_processes(processes)
    assert {r.proc for r in own.collect()} == {0, 3}
    assert [tuple(r) for r in behaviour.encryption_onset(calls, own, 2).collect()] == [(1, 2, 103, 5)]
    assert behaviour.encryption_onset(calls, own, 3).count() == 0
    files = spark.createDataFrame([(1, f"C:\\{d}\\Help.TXT") for d in "abcde"] + [(1, "c:\\a\\x.doc")], "run_id int, value string")
    assert [tuple(r) for r in behaviour.note_onset(calls, own, files).collect()] == [(1, 1, 108, 11)]
    assert [r.coarse_encryption for n in (4, 5) for r in behaviour.coarse_encryption(calls, own=own, least=n).collect()] == [1, 0]
    listed = spark.createDataFrame([(1, 0, "bcdedit /x")], "run_id int, pos long, value string")
    marks = behaviour.report_behaviours(calls, processes, listed, files, rewrites=2)
    # The listed command has the time of the first own call, as has a call without one; a bystander's command counts, its calls do not.
    assert behaviour.behaviours(marks).first().sequence == ["SHADOW_DELETE", "RECOVERY_DISABLE", "RM_SESSION", "FILE_ENCRYPT", "RANSOM_NOTE"]
