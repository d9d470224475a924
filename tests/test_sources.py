"""Logs, binaries and pictures read in parts, batches with a commit log, and streams of calls, against plain readings."""

import gzip
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pytest

from tidemark.operators import events, images
from tidemark.sources import reports, sinks


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of 97 bytes, and batches have seven rows."""
    settings = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_times_are_carried_over_ranges_and_rotated_files(spark, small_ranges, tmp_path):
    rng, clock, files, want = random.Random(1), itertools.count(), {}, set()
    names = ["b.log", "a.log.10.gz", "a.log.2", "a.log.1", "a.log"]
    for name in names:
        lines, last = [], None if name in ("b.log", "a.log.10.gz") else last  # noqa: F821
        for i in range(0 if name == "a.log.2" else 60):
            if rng.random() < 0.08 and not (name == "a.log.1" and i < 30):
                last = next(clock)
                lines.append(f"2024-01-02 03:{last // 60:02d}:{last % 60:02d},5 said {'x' * rng.randint(0, 40)}")
            else:
                lines.append(rng.choice(["", "  more é", "y" * rng.randint(1, 150), "2024-01-02 no time"]))
            want.add((name, i, lines[-1], last))
        files[name] = "\n".join(lines) + ("\n" if lines and name != "a.log" else "")
    for name, text in files.items():
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    found = reports.log_lines(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 1
    got = {(r.path.rpartition("/")[2], r.line, r.text, None if r.ts is None else r.ts.minute * 60 + r.ts.second) for r in found.collect()}
    lines = lambda rows: {x for x in rows if not (x[0] == "a.log" and x[1] == 59 and not x[2])}  # noqa: E731  a last line without end or text is none
    assert lines(got) == lines(want)
    assert {r.log.rpartition("/")[2] for r in found.collect()} == {"a.log", "b.log"}


@pytest.mark.parametrize("separator", ["\n", "\0"])
def test_printable_runs_over_borders(spark, small_ranges, tmp_path, separator):
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(0, 256, 300, dtype=np.uint8)), b"A" * 500, b"\n\r\0four\0" * 9, b"\xff" + b"over the border " * 40 + b"\x80", bytes(1000), b"tail!"]
    rng.shuffle(parts)
    data = {"one": b"".join(parts), "two": b"".join(parts[::-1]), "none": b""}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    got = sorted((r.path.rpartition("/")[2], r.run) for r in reports.printable_runs(spark, str(tmp_path), separator=separator).collect())
    assert got == sorted((name, m.decode()) for name, raw in data.items() for m in re.findall(rb"[\x20-\x7e]{5,}", raw))
    with pytest.raises(ValueError, match="separator"):
        reports.printable_runs(spark, str(tmp_path), separator="x")


def test_csv_of_a_missing_file_only(spark, tmp_path):
    assert reports.csv_table(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    sinks.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "c"), ["a", "b", "c"])
    sinks.write_csv(spark.createDataFrame([(2, "x")], "a int, b string"), str(tmp_path / "c"), ["a", "b", "c"], "append")
    assert sorted(map(tuple, reports.csv_table(spark, str(tmp_path / "c"), ["a", "b", "c"]).collect())) == [("1", None, None), ("2", "x", None)]


def test_patterns_with_their_legend(spark, tmp_path):
    sinks.write_patterns(spark.createDataFrame([(1, 0, 1)], "run_id int, p0 int, p1 int"), spark.createDataFrame([("p0", "a,b"), ("p1", "c")], "column string, pattern string"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/matrix")).columns == ["run_id", "p0", "p1"]
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p/legend")).collect()} == {("p0", "a,b"), ("p1", "c")}


def test_a_run_that_ends_before_its_mark_changes_nothing(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "id long, sha string"
    frame = lambda rows: spark.createDataFrame(rows, "id long, sha string, v string")
    repeated = lambda df: sorted(map(tuple, df.collect()))
    assert sinks.committed(spark, folder) is None
    assert sinks.commit_log(spark, folder, schema).count() == 0
    assert repeated(sinks.write_batch(frame([(1, "a", "x"), (2, "b", "x"), (3, "a", "x"), (3, "a", "x")]), folder, "id", "sha")) == [(3, "a", 1)]
    frame([(4, "c", "lost")]).write.parquet(f"{folder}/parts/batch={7:020d}")  # no log
    frame([(4, "c", "lost")]).select("id", "sha").write.parquet(f"{folder}/log/batch={8:020d}")
    (tmp_path / "t" / "log" / f"batch={8:020d}" / "_SUCCESS").unlink()  # a log without its mark
    now = lambda: sorted(((r.id, r.v) for r in sinks.committed(spark, folder).collect()), key=str)
    assert now() == [(1, "x"), (2, "x"), (3, "x")]
    assert repeated(sinks.write_batch(frame([(1, "changed", "y"), (4, "c", "y"), (5, "b", "y"), (None, "z", "y")]), folder, "id", "sha")) == [(5, "b", 2)]
    assert now() == sorted([(1, "x"), (2, "x"), (3, "x"), (4, "y"), (5, "y"), (None, "y")], key=str)
    assert repeated(sinks.write_batch(frame([(1, "a", "z"), (5, "b", "z"), (None, "z", "z")]), folder, "id", "sha")) == []
    assert len(now()) == 6


def test_repetitiveness_over_batches(spark, small_ranges):
    rng = random.Random(2)
    runs = {r: [rng.choice(["a", "b", None, f"c{rng.randint(0, 400)}"][: rng.randint(1, 4)]) for _ in range(n)] for r, n in enumerate([1, 6, 7, 8, 500, 9_000, 13])}
    rows = [(r, i, a) for r, apis in runs.items() for i, a in enumerate(apis)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id int, pos long, api string")
    for most in (200_000, 450):
        want = {}
        for r, apis in runs.items():
            seen, stream = {}, bytearray()
            for a in apis[:most]:
                stream.append(seen.setdefault(a, len(seen)) % 256)
            want[r] = (len(stream), round(len(zlib.compress(bytes(stream), 6)) / len(stream), 5))
        assert {r.run_id: (r.n_calls, r.repetitiveness) for r in events.repetitiveness(df, most).collect()} == want


def png(x):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in x)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pictures(spark, tmp_path):
    rng = np.random.default_rng(0)
    desk = rng.integers(0, 40, (240, 325, 3)).astype(np.uint8)
    icons, toast, clock = desk.copy(), desk.copy(), desk.copy()
    icons[:60, :40] = 200
    toast[190:, 250:] = 200
    clock[200:] = 255
    blank = np.full((240, 325, 3), 250, np.uint8)
    sets = {"r1": [desk, icons, toast, blank], "r2": [desk, toast, clock], "r3": [desk], "r4": [desk, blank], "r5": [desk] * 31 + [icons] + [desk] * 2, "r6": [desk, icons[::2, ::2]]}
    for run, pictures in sets.items():
        (tmp_path / run / "shots").mkdir(parents=True)
        for i, x in enumerate(pictures):
            (tmp_path / run / "shots" / f"{i + 8}.png").write_bytes(png(np.ascontiguousarray(x)))
    (tmp_path / "r3" / "shots" / "broken.png").write_bytes(b"nothing")
    found = images.frames(spark, str(tmp_path))
    one = found.filter("run_id = 'r1' and shot = '9.png'").first()
    assert (one.height, one.width) == (240, 325)
    assert np.array_equal(np.frombuffer(one.rgb, np.uint8).reshape(240, 325, 3), icons)
    got = {r.run_id: r for r in images.screen_change(found).collect()}
    # Cells are 20 x 20; the icons' region has 6 columns and, above the task bar, 10 rows.
    assert {k: (r.n_shots, r.cells_changed, r.cells_usable, r.visual_change, r.peak_shot) for k, r in got.items()} == {
        "r1": (4, 6, 60, "yes", "9.png"), "r2": (3, 0, 60, "no", "9.png"), "r3": (1, None, None, "unknown", None), "r4": (2, None, None, "unreadable", None),
        "r5": (34, 0, 60, "no", "9.png"), "r6": (2, 6, 60, "yes", "9.png"),
    }
    whole = {r.run_id: r.cells_changed for r in images.screen_change(found, icons=False).collect()}
    assert whole["r1"] == 6 and whole["r2"] == 0
    assert images.changed_cells(desk, toast)[0] > 0 and images.changed_cells(desk, clock)[0] >= 32
    every = images.screen_change(found, most=40).filter("run_id = 'r5'").first()
    assert (every.cells_changed, every.peak_shot) == (6, "39.png")


@pytest.mark.parametrize("n", [2, 21, 22, 50])
def test_evenly_spaced_pictures(spark, n):
    """A change in one later picture is seen if and only if that picture is among the evenly spaced ones."""
    later = list(range(1, n))
    picked = later if len(later) <= 20 else [later[int(i * len(later) / 20)] for i in range(20)]
    if later[-1] not in picked:
        picked[-1] = later[-1]
    x = np.zeros((120, 96, 3), np.uint8)
    x[::2] = 60
    rows = [(str(marked), i, 120, 96, bytearray((255 - x if i == marked else x).tobytes())) for marked in later for i in range(n)]
    df = spark.createDataFrame(rows, "run_id string, shot long, height int, width int, rgb binary")
    got = {int(r.run_id): (r.n_shots, r.pixel_change_fraction) for r in images.screen_change(df).collect()}
    assert got == {m: (n, float(m in picked)) for m in later}


def test_pictures_are_small_where_they_are_shuffled(spark):
    pixels = bytes(96 * 120 * 3)
    df = spark.createDataFrame([("r", str(i), 120, 96, bytearray(pixels) if i else None) for i in range(3)], "run_id string, shot string, h int, w int, rgb binary")
    rows = {r.shot: r.rgb for r in images.packed(df).collect()}
    assert rows["0"] is None and all(len(rows[s]) < len(pixels) // 50 and zlib.decompress(rows[s]) == pixels for s in "12")
