"""Token ids on disk: canonical length-limited Huffman codes from global counts, decoded in blocks by table.

Layout of a written folder, all through Spark's own writer, so that it works in any store and survives lost tasks:

    codebook/  one row: the code length of each id (0: never seen), as bytes; canonical codes follow from it
    parts/     one row per part, a range of doc_id: part, first (ids before it), n_tokens
    tokens/    one row per document, ascending in doc_id in each file and from file to file: doc_id, part, local_start,
               n_tokens, payload (bits, first bit highest), marks (bit offset of each block of BLOCK ids)

A block is BLOCK ids of one document; its mark lets it be decoded on its own, and all blocks of a batch are decoded in
step, one table look-up per id.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chunks import encoder, vocabulary_path
from tidemark.llm.common import plain_docs, scratch, shared_dir, slices, table, tidy, written

BLOCK = 256
#: Longest code, unless the ids seen need more bits.
LONGEST = 16
#: Documents in a part, and parts at most; larger tables get larger parts.
DOCS_A_PART, PARTS = 8192, 65_536


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits for ids with these counts, by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    seen = np.flatnonzero(counts)
    if len(seen) < 2:
        lengths[seen] = 1
        return lengths
    longest = max(longest, int(np.ceil(np.log2(len(seen)))))
    seen = seen[np.argsort(counts[seen], kind="stable")]
    leaves = counts[seen].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        level = np.concatenate([leaves, packages])
        order = np.argsort(level, kind="stable")
        level = level[order]
        is_leaf.append(order < len(leaves))
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for flags in reversed(is_leaf):
        n = int(flags[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    lengths[seen] = depth
    return lengths


class Code:
    """Canonical codes and the decoding table of some code lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint64)
        self.longest = int(lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        steps = np.uint64(1) << (np.uint64(self.longest) - self.lengths[order])
        starts = np.cumsum(steps) - steps
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = starts >> (np.uint64(self.longest) - self.lengths[order])
        fill = (1 << self.longest) - int(steps.sum())
        self.symbol = np.concatenate([np.repeat(order, steps.astype(np.int64)), np.zeros(fill, np.int64)]).astype(np.uint32)
        self.length = np.concatenate([np.repeat(lengths[order], steps.astype(np.int64)), np.ones(fill, np.uint8)]).astype(np.int64)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Payload and marks of documents whose ids lie one after another."""
        lengths = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(lengths)
        offsets = ends - lengths
        stops = np.cumsum(sizes)
        begins = stops - sizes
        has = sizes > 0
        bits = np.zeros(len(sizes), np.int64)
        bits[has] = ends[stops[has] - 1] - offsets[begins[has]]
        words = (bits + 31) // 32
        word_stops = np.cumsum(words)
        word_begins = word_stops - words
        shift = np.zeros(len(sizes), np.int64)
        shift[has] = word_begins[has] * 32 - offsets[begins[has]]
        offsets += np.repeat(shift, sizes)
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        if len(ids):
            at = offsets >> 5
            window = self.codes[ids] << (64 - (offsets & 31) - lengths).astype(np.uint64)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            out[at[first]] += np.add.reduceat(window >> np.uint64(32), first)
            out[at[first] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), first)
        packed = out.astype(">u4")
        payload = [packed[a:b].tobytes() for a, b in zip(word_begins, word_stops, strict=True)]
        marks = [(offsets[a:b:BLOCK] - w * 32).astype("<u8").tobytes() for a, b, w in zip(begins, stops, word_begins, strict=True)]
        return payload, marks

    def decode(self, payload: list[bytes], marks: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Ids of the documents, one after another."""
        out = np.zeros(int(sizes.sum()), np.uint32)
        if not len(out):
            return out
        words = np.frombuffer(b"".join([*payload, b"\0" * 8]), ">u4").astype(np.uint64)
        word_sizes = np.fromiter((len(p) // 4 for p in payload), np.int64, len(payload))
        blocks = np.fromiter((len(m) // 8 for m in marks), np.int64, len(marks))
        place = np.frombuffer(b"".join(marks), "<u8").astype(np.int64) + np.repeat((np.cumsum(word_sizes) - word_sizes) * 32, blocks)
        nth = np.arange(len(place)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        to = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        left = np.minimum(np.repeat(sizes, blocks) - nth * BLOCK, BLOCK)
        order = np.argsort(-left, kind="stable")  # the blocks that still go on come first
        place, to, left = place[order], to[order], left[order]
        active = len(left)
        for step in range(BLOCK):
            active = int(np.searchsorted(-left[:active], -step, "left"))
            if not active:
                break
            at = place[:active] >> 5
            window = (words[at] << np.uint64(32)) | words[at + 1]
            back = (64 - self.longest - (place[:active] & 31)).astype(np.uint64)
            key = ((window >> back) & np.uint64((1 << self.longest) - 1)).astype(np.int64)
            out[to[:active] + step] = self.symbol[key]
            place[:active] += self.length[key]
        return out


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of documents, one after another, with the end id after each, and the documents' numbers of ids."""
    if end_id is None:
        return ids, sizes
    ends = np.cumsum(sizes + 1) - 1
    out = np.empty(len(ids) + len(sizes), np.uint32)
    own = np.ones(len(out), bool)
    own[ends] = False
    out[own], out[ends] = ids, end_id
    return out, sizes + 1


def id_rows(docs: DataFrame, path: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, 16 bits each where every id fits, else 32) of each row, and one more row
    per task with nothing but `counts`, how often each id occurs in the task's rows (64 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = encoder(path), np.zeros(0, np.int64)
        names = ["doc_id", "n_tokens", "ids", "counts"]
        with own.task():
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    ids, sizes = with_end(*own.batch(texts), end_id)
                    found = np.bincount(ids, minlength=len(total))
                    found[: len(total)] += total
                    total = found
                    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
                    flat, size = (ids, 4) if wide else (ids.astype("<u2"), 2)
                    ends = pa.array(np.r_[0, np.cumsum(sizes) * size].astype(np.int32))
                    cut = pa.Array.from_buffers(pa.binary(), len(sizes), [None, ends.buffers()[1], pa.py_buffer(flat.tobytes())])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), cut, pa.nulls(len(sizes), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names)

    return plain_docs(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary, counts binary")


def _unpack(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of `id_rows` of about `most` ids, their sizes, and their ids one after another."""
    sizes = batch.column("n_tokens").to_numpy()
    stops, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = stops[start - 1] if start else 0
        stop = max(start + 1, int(stops.searchsorted(before + most, "right")))
        part = batch.slice(start, stop - start)
        rows = part.column("ids").to_pylist()
        ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4") for x, n in zip(rows, sizes[start:stop].tolist(), strict=True)]
        yield part, sizes[start:stop], np.concatenate([np.zeros(0, np.uint16), *ids]).astype(np.int64)
        start = stop


def id_counts(rows: DataFrame) -> DataFrame:
    """id and count over all rows of `id_rows`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                found = np.frombuffer(x, "<i8")
                total = np.r_[total, np.zeros(max(0, len(found) - len(total)), np.int64)]
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return rows.select("counts").filter("counts is not null").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes all texts and writes `folder`. A null text counts as empty: it has the end id alone. Repeated rows stay,
    those with one doc_id in the order of their ids; rows without a doc_id come first; an empty table gives no rows."""
    spark = docs.sparkSession
    with scratch(spark):  # the ids go when the files are written
        _write_tokens(spark, id_rows(docs, path, end_id, doc_id, text), folder)


def _write_tokens(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    rows = written(spark, rows, "ids")
    counts = id_counts(rows).collect()  # one row per id of the vocabulary at most
    rows = rows.filter("counts is null").drop("counts")
    dense = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        dense[r.id] = r.n
    lengths = code_lengths(dense)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/codebook")
    book = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, done = Code(book.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, sizes, ids in _unpack(batch):
                payload, marks = code.encode(ids, sizes)
                starts = done + np.cumsum(sizes) - sizes
                done += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.full(len(sizes), task), pa.int64()), pa.array(starts, pa.int64()), part.column("n_tokens"), pa.array(payload, pa.binary()), pa.array(marks, pa.binary())],
                    ["doc_id", "part", "local_start", "n_tokens", "payload", "marks"],
                )

    n = min(PARTS, max(1, -(-rows.count() // DOCS_A_PART)))
    placed = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    placed.mapInArrow(tidy(run), "doc_id long, part long, local_start long, n_tokens long, payload binary, marks binary").write.option("compression", "none").parquet(f"{folder}/tokens")
    parts = spark.read.parquet(f"{folder}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).orderBy("part").collect()  # PARTS rows at most
    first, listed = 0, []
    for r in parts:
        listed.append((r.part, first, r.n_tokens))
        first += r.n_tokens
    spark.createDataFrame(listed, "part long, first long, n_tokens long").coalesce(1).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start and n_tokens of each document in `folder`, with ids (array of ints), or with the crc32 of their
    little-endian 32-bit form where `digest` is set."""
    book = spark.sparkContext.broadcast(np.frombuffer(bytes(spark.read.parquet(f"{folder}/codebook").first()[0]), np.uint8))
    last, kind = ("ids_crc32", "long") if digest else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(book.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sizes = part.column("n_tokens").to_numpy()
                ids = code.decode(part.column("payload").to_pylist(), part.column("marks").to_pylist(), sizes)
                stops = np.cumsum(sizes)
                cut = [ids[a:b] for a, b in zip(stops - sizes, stops, strict=True)]
                found = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")), found], ["doc_id", "part", "local_start", "n_tokens", last])

    rows = spark.read.parquet(f"{folder}/tokens").mapInArrow(tidy(run), f"doc_id long, part long, local_start long, n_tokens long, {last} {kind}")
    parts = spark.read.parquet(f"{folder}/parts").select("part", "first")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", last)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tidemark/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary_path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, folder, digest=True)
