"""Import tables of hand-made executables, whole, cut off and with hostile numbers."""

import random
import struct

import pyarrow as pa
import pytest

from tidemark.sources.executables import Image, Malformed, import_tables


def executable(wide=False, libraries=(("A.dll", ["one", 7, "two"]), ("b.DLL", ["three"])), first=True):
    """Bytes of an executable with two sections, the imports in the second."""
    width, kind, directories = (8, 0x20B, 112) if wide else (4, 0x10B, 96)
    base, body = 0x2000, bytearray(20 * (len(libraries) + 1))

    def put(data):
        body.extend(data)
        return base + len(body) - len(data)

    for i, (dll, names) in enumerate(libraries):
        entries = [(1 << (8 * width - 1)) | n if isinstance(n, int) else put(b"\1\2" + n.encode() + b"\0") for n in names]
        table = put(b"".join(e.to_bytes(width, "little") for e in [*entries, 0]))
        struct.pack_into("<IIIII", body, 20 * i, table if first else 0, 0, 0, put(dll.encode() + b"\0"), table)
    optional = bytearray(directories + 128)
    struct.pack_into("<H", optional, 0, kind)
    struct.pack_into("<I", optional, 60, 0x400)
    struct.pack_into("<I", optional, directories - 4, 16)
    struct.pack_into("<II", optional, directories + 8, base, 20 * len(libraries))
    coff = struct.pack("<HHIIIHH", 0x8664, 2, 0, 0, 0, len(optional), 0)
    section = lambda address, size, place: bytes(8) + struct.pack("<IIII", size, address, size, place) + bytes(16)
    head = b"MZ" + bytes(0x3A) + struct.pack("<I", 0x80) + bytes(0x40) + b"PE\0\0" + coff + bytes(optional) + section(0x1000, 0x100, 0x400) + section(base, len(body), 0x500)
    return head.ljust(0x500, b"\0") + bytes(body)


WANT = [("A.dll", "one"), ("A.dll", "two"), ("b.DLL", "three")]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("first", [False, True])
def test_names_by_library(wide, first):
    assert list(Image(executable(wide, first=first)).imports()) == WANT


def test_any_bytes_give_an_answer():
    rng = random.Random(4)
    whole = executable()
    seen = set()
    for n in range(0, len(whole), 7):
        try:
            found = list(Image(whole[:n]).imports())
            assert found == WANT[: len(found)]
        except Malformed as e:
            seen.add(str(e))
    assert {"no executable", "outside of the file"} <= seen
    for _ in range(3_000):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(0x3C, len(data) - 4)
            data[at : at + 4] = rng.choice([b"\xff\xff\xff\xff", b"\0\0\0\x80", bytes(rng.randrange(256) for _ in range(4)), b"\0\x20\0\0"])
        try:
            assert sum(1 for _ in Image(bytes(data)).imports()) < 100_000
        except Malformed:
            pass


def test_import_tables(spark):
    files = [("a", executable()), ("none", executable(libraries=())), ("numbers", executable(libraries=(("x.dll", [1, 2]),))), ("text", b"hello"), ("empty", b""), ("null", None), ("cut", executable()[:0x180])]
    rows = spark.createDataFrame([(p, None if c is None else bytearray(c), 1) for p, c in files], "path string, content binary, name int")
    got = {}
    for r in import_tables(rows).orderBy("path", "place").collect():
        got.setdefault(r.path, []).append((r.dll, r.name, r.error))
    assert got == {
        "a": [(*w, None) for w in WANT], "none": [(None, None, None)], "numbers": [(None, None, None)], "text": [(None, None, "no executable")],
        "empty": [(None, None, "no executable")], "null": [(None, None, "no executable")], "cut": [(None, None, "outside of the file")],
    }
    assert import_tables(rows.limit(0)).count() == 0


class Plain:
    """Stands for a table: gives back what would run in its tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_names_of_many_files_are_handed_on_together(monkeypatch, spark):
    monkeypatch.setattr("tidemark.sources.executables.HANDED", 50)
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(100)]), pa.array([executable()] * 100, pa.binary())], ["path", "content"])
    given = list(import_tables(Plain())(iter([batch, batch, batch])))
    assert [b.num_rows for b in given] == [51] * 17 + [33]
    assert [n for b in given for n in b.column("name").to_pylist()] == ["one", "two", "three"] * 300


def test_executables_of_a_small_table_are_dealt_out(spark):
    from tidemark.plans.catalog import QUERIES

    assert QUERIES["s07_import_table"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
