"""The names that executables import, read from their bytes alone; nothing is ever loaded or run.

The format is the published one: a header at the place that the first one names, a table of sections that maps addresses to
places in the file, and a directory of imported libraries, each with a table of names. Every number is checked against the
file's length before it is followed, and counts are bounded, so that any bytes give an answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import unpack_from

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Libraries, names of a library, sections, and characters of a name that are read at most.
LIBRARIES, NAMES, SECTIONS, LENGTH = 4_096, 65_536, 96, 512
#: Names after which a task hands on what it has.
HANDED = 8_192

#: Fixed values of the format: kind of optional header -> (place of its directories, width of a table's entries).
KINDS = {0x10B: (96, 4), 0x20B: (112, 8)}


class Malformed(ValueError):
    """What a file has in place of an executable's tables."""


class Image:
    """Sections of an executable, and its import directory."""

    def __init__(self, data: bytes):
        self.data = data
        if data[:2] != b"MZ":
            raise Malformed("no executable")
        at = self.number(0x3C)
        if self.part(at, 4) != b"PE\0\0":
            raise Malformed("no header")
        count, header = self.number(at + 6, 2), self.number(at + 20, 2)
        optional = at + 24
        kind = self.number(optional, 2)
        if kind not in KINDS:
            raise Malformed("unknown kind")
        directories, self.width = KINDS[kind]
        self.headers = self.number(optional + 60)
        self.sections = []
        for i in range(min(count, SECTIONS)):
            size, address, raw, place = unpack_from("<IIII", self.part(optional + header + 40 * i + 8, 16))
            self.sections.append((address, max(size, raw), raw, place))
        has = self.number(optional + directories - 4) > 1 and header >= directories + 16
        self.directory = self.number(optional + directories + 8) if has else 0

    def part(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > len(self.data):
            raise Malformed("outside of the file")
        return self.data[at : at + n]

    def number(self, at: int, n: int = 4) -> int:
        return int.from_bytes(self.part(at, n), "little")

    def place(self, address: int) -> int:
        """Where in the file an address is."""
        for start, size, raw, place in self.sections:
            if start <= address < start + size:
                if address - start >= raw:
                    raise Malformed("not in the file")
                return place + address - start
        if address < self.headers:
            return address
        raise Malformed("in no section")

    def text(self, at: int) -> str:
        end = self.data.find(b"\0", at, at + LENGTH + 1)
        if end < 0 or at >= len(self.data):
            raise Malformed("name without an end")
        return self.data[at:end].decode("utf-8", "ignore")

    def imports(self) -> Iterator[tuple[str, str]]:
        """Library and name; numbers in place of names are left out. A table that leads out of the file ends there."""
        at = self.place(self.directory) if self.directory else -1
        for i in range(LIBRARIES if at >= 0 else 0):
            names, _, _, library, bound = unpack_from("<IIIII", self.part(at + 20 * i, 20))
            if not library:
                return
            try:
                own, table = self.text(self.place(library)), self.place(names or bound)
                for j in range(NAMES):
                    entry = self.number(table + self.width * j, self.width)
                    if not entry:
                        break
                    if not entry >> (8 * self.width - 1) and (name := self.text(self.place(entry & 0x7FFFFFFF) + 2)):
                        yield own, name
            except Malformed:
                continue


def import_tables(files: DataFrame) -> DataFrame:
    """path, place, dll, name, error of files (path, content as bytes): a row for each imported name in the order of the file,
    or one row with `error` where the bytes are no executable or its directory lies outside of them (dll and name are NULL).
    An executable without imports, or with numbers only, has one row without dll, name and error. NULL content is an error."""

    def rows_of(path: str, data: bytes | None) -> list[tuple]:
        found: list[tuple] = []
        try:
            for dll, name in Image(data or b"").imports():
                found.append((path, len(found), dll, name, None))
        except Malformed as e:
            if not found:
                return [(path, 0, None, None, str(e))]
        return found or [(path, 0, None, None, None)]

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["path", "place", "dll", "name", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one content at a time
                found += rows_of(path, data.as_py())
                if len(found) >= HANDED:
                    yield batch_of(found)
                    found = []
        if found:
            yield batch_of(found)

    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, "path string, place long, dll string, name string, error string")
