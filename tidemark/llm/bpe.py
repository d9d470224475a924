"""Byte-level BPE encoding and decoding with a contiguous rank array per short word.

A word is held as two lists: its parts, and beside each part the rank of its pair with the next one. The smallest rank
is found by a scan, the boundary behind it is deleted, and the ranks of the two neighbouring pairs are refreshed. Words
over `SHORT` bytes, where scans would cost the square of the length, take the same merges from a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.chunks import Chunked, vocabulary_path
from tidemark.llm.common import plain_docs, slices, table, tidy

SHORT = 128
NEVER = 1 << 60
#: The public byte-level pre-token pattern and Unicode's white space.
SPACE = "".join(f"\\u{c:04x}" for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, by rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes, merges as (left id, right id) -> (rank, id), and the added strings, from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        chars = byte_alphabet()
        ids = found["model"]["vocab"]
        self.tokens = {i: bytes(chars[c] for c in t) for t, i in ids.items()}
        self.byte_ids = [0] * 256
        for i, t in self.tokens.items():
            if len(t) == 1:
                self.byte_ids[t[0]] = i
        self.merges = {}
        for rank, pair in enumerate(found["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.added = {t["content"]: t["id"] for t in found["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        self.pretoken = regex.compile(PRETOKEN)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")" if self.added else "(?!)")

    def pretokens(self, text: str) -> Iterator[str | int]:
        """The pre-tokens of a text; an added string counts as its id."""
        for part in self.split_added.split(text) if any(a in text for a in self.added) else [text]:
            if part in self.added:
                yield self.added[part]
            elif part:
                yield from self.pretoken.findall(part)


def merge_short(ids: list[int], merges: dict) -> list[int]:
    none = (NEVER, 0)
    pairs = [merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
    ranks = [p[0] for p in pairs]
    while ranks and (low := min(ranks)) < NEVER:
        i = ranks.index(low)
        ids[i] = pairs[i][1]
        del ids[i + 1], ranks[i], pairs[i]
        for k in (i - 1, i):
            if 0 <= k < len(ranks):
                pairs[k] = merges.get((ids[k], ids[k + 1]), none)
                ranks[k] = pairs[k][0]
    return ids


def merge_long(ids: list[int], merges: dict) -> list[int]:
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = merges[a, b][1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for left, right in ((before[i], i), (i, k)):
            if left >= 0 and right < n and (m := merges.get((ids[left], ids[right]))):
                heapq.heappush(heap, (m[0], left, ids[left], ids[right]))
    return [x for x in ids if x >= 0]


class Codec:
    """encode: texts to ids; decode: ids back to text."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.text_of = self.vocabulary.tokens
        self.decimal = {i: str(i) for i in self.text_of}
        self.chunked = Chunked(self._ask, self._words, list(self.vocabulary.added))

    def _merged(self, word: bytes) -> list[int]:
        v = self.vocabulary
        parts = [v.byte_ids[b] for b in word]
        return merge_short(parts, v.merges) if len(parts) <= SHORT else merge_long(parts, v.merges)

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            ids: list[int] = []
            for word in self.vocabulary.pretokens(text):
                ids += [word] if isinstance(word, int) else self._merged(word.encode())
            out.append(np.array(ids, np.uint32))
        return out

    def _words(self, data: bytes, sizes: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """A chunk of letters, with a space before it or none, is one pre-token."""
        stops, ids, n = np.cumsum(sizes).tolist(), [], []
        for a, b in zip([0, *stops[:-1]], stops, strict=True):
            found = self._merged(data[a:b])
            ids += found
            n.append(len(found))
        return np.array(n, np.int64), np.array(ids, np.uint32)

    def encode(self, texts: pa.Array | list[str]) -> list[list[int]]:
        flat, sizes = self.chunked.batch(texts)
        flat, stops = flat.tolist(), np.cumsum(sizes).tolist()
        return [flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of ints) of each row. A null text counts as empty and has no ids; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        with own.chunked.task():
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    ids = pa.array(own.encode(texts), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return plain_docs(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null ids count as none. Bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"cast(`{ids}` as array<int>) ids").mapInArrow(tidy(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; encodes and decodes in one pass, without moving ids.

    A null text counts as empty: no tokens, the digests of nothing. Repeated rows and rows with a null doc_id stay; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        decimal = own.decimal.__getitem__
        with own.chunked.task():
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    rows = own.encode(texts)
                    ids = [hashlib.sha256(",".join(map(decimal, x)).encode()).hexdigest() for x in rows]
                    back = [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in rows]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, rows), pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return plain_docs(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
