"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

Each task packs the documents that it reads, one after another, so nothing is shuffled. It keeps an array with the
number of open windows at each fill level. A document goes where the sum of the squares of these numbers grows least:
into an open window of some level, or into a new one; full windows do not count. A document longer than a window fills
whole windows first. Where too many windows are open, and at the end of the task, pieces of the emptiest window are cut
to fill the fullest, so that a task leaves one partly filled window at most, and its memory is bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.chunks import encoder, vocabulary_path
from tidemark.llm.common import plain_docs, slices, table, tidy
from tidemark.llm.token_output import with_end

WINDOW = 4096
#: Open windows of a task at most.
OPEN = 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: doc_id, start, ids as bytes, tokens of the document
Piece = tuple[int, int, bytes, int]


class Packer:
    """Places pieces; `put` and `finish` give back the windows that got full or were closed, as lists of pieces."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN):
        self.window, self.most_open = window, most_open
        self.counts = np.zeros(window + 1, np.int64)  # open windows at each level
        self.at: dict[int, list[list[Piece]]] = {}  # the windows themselves
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """Level of the window that takes a piece of this size; 0: a new one. Ties go to the fullest."""
        last = self.window - size  # the fullest level that has room
        taken = self.counts[: last + 1]
        after = 2 * self.counts[size:] + 1
        after[-1] = 0  # a full window is no longer open
        growth = after - 2 * taken + 1
        growth[0] = after[0]
        growth[1:][taken[1:] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(growth[::-1]))

    def put(self, doc_id: int, ids: bytes) -> Iterator[list[Piece]]:
        n, full = len(ids) // 4, self.window
        whole = n // full * full
        for start in range(0, whole, full):
            yield [(doc_id, start, ids[4 * start : 4 * (start + full)], n)]
        if n > whole:
            yield from self._place((doc_id, whole, ids[4 * whole :], n))
        while self.n_open > self.most_open:
            yield from self._top_up()

    def _place(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece[2]) // 4
        level = self.level_for(size)
        pieces = self._take(level) if level else []
        pieces.append(piece)
        yield from self._give(level + size, pieces)

    def _take(self, level: int) -> list[Piece]:
        found = self.at[level].pop()
        if not self.at[level]:
            del self.at[level]
        self.counts[level] -= 1
        self.n_open -= 1
        return found

    def _give(self, level: int, pieces: list[Piece]) -> Iterator[list[Piece]]:
        if level == self.window:
            yield pieces
        else:
            self.at.setdefault(level, []).append(pieces)
            self.counts[level] += 1
            self.n_open += 1

    def _top_up(self) -> Iterator[list[Piece]]:
        """Fills the fullest window with pieces of the emptiest one; the last of them is cut."""
        high, low = max(self.at), min(self.at)
        target, source = self._take(high), self._take(low)
        room = self.window - high
        while room and source:
            doc_id, start, ids, n = source.pop()
            size = len(ids) // 4
            if size > room:
                source.append((doc_id, start + room, ids[4 * room :], n))
                ids, size = ids[: 4 * room], room
            target.append((doc_id, start, ids, n))
            room -= size
        yield from self._give(self.window - room, target)
        if source:
            yield from self._give(sum(len(p[2]) for p in source) // 4, source)

    def finish(self) -> Iterator[list[Piece]]:
        while self.n_open > 1:
            yield from self._top_up()
        for windows in self.at.values():
            yield from windows


def packed(docs: DataFrame, path: str, end_id: int | None = 2, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty and gives a piece with the end id alone (no piece without an end id). Repeated rows are
    packed as often as they occur; an empty table gives no rows. A sequence is named by its task and its number there.
    """

    def rows_of(windows: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
        rows = []
        for sequence, pieces in windows:
            offset = 0
            for doc, start, ids, n in pieces:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, sequence, offset))
                offset += len(ids) // 4
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, packer = encoder(path), Packer(window)
        sequence, done = TaskContext.get().partitionId() << 32, []
        with own.task():
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    ids, sizes = with_end(*own.batch(texts), end_id)
                    raw, stops = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
                    for doc, a, b in zip(part.column("doc_id").to_pylist(), [0, *stops[:-1]], stops, strict=True):
                        for pieces in packer.put(doc, raw[a:b]):
                            done.append((sequence, pieces))
                            sequence += 1
                    if len(done) >= 256:
                        yield rows_of(done)
                        done = []
        for pieces in packer.finish():
            done.append((sequence, pieces))
            sequence += 1
        if done:
            yield rows_of(done)

    return plain_docs(docs, doc_id, text).mapInArrow(tidy(run), SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=2)
