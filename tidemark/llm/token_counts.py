"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie in one array of symbols, with the place where each begins. In every round each of them
applies its own lowest-rank pair at all its places at once, and those without a pair leave with the number of symbols
they have left. No merge makes a pair that ranks before itself, so this gives the ids that one merge at a time gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import Vocabulary
from tidemark.llm.chunks import Chunked, vocabulary_path
from tidemark.llm.common import plain_docs, slices, table, tidy

NEVER = np.iinfo(np.int64).max


class RaggedMerger:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.width = max(vocabulary.tokens) + 1
        pairs = np.array([a * self.width + b for a, b in vocabulary.merges], np.int64)
        made = np.array(list(vocabulary.merges.values()), np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks, self.made = pairs[order], made[order, 0], made[order, 1]
        self.first = np.array(vocabulary.byte_ids, np.int64)

    def count(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        """Symbols that survive of each word; data has the words' bytes one after another."""
        left = sizes.astype(np.int64)
        symbols = self.first[np.frombuffer(data, np.uint8)]
        live = np.flatnonzero(left > 0)  # the words that lie in `symbols`
        while len(live):
            sizes = left[live]
            starts = np.cumsum(sizes) - sizes
            at, ranks = self._ranks(symbols, starts + sizes - 1)
            low = np.minimum.reduceat(ranks, starts)
            merge = (ranks == np.repeat(low, sizes)) & (ranks != NEVER)
            # In a run of places of one pair, as in a a a, every second one holds.
            places = np.flatnonzero(merge)
            if len(places):
                run = np.r_[True, np.diff(places) > 1]
                since = places - places[np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))]
                places = places[since % 2 == 0]
            symbols[places] = self.made[at[places]]
            gone = np.zeros(len(symbols), bool)
            gone[places + 1] = True
            sizes = sizes - np.add.reduceat(gone, starts, dtype=np.int64)
            left[live] = sizes
            goes_on = low != NEVER
            symbols = symbols[~gone]
            if not goes_on.all():
                symbols, live = symbols[np.repeat(goes_on, sizes)], live[goes_on]
        return left

    def _ranks(self, symbols: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = symbols * self.width
        keys[:-1] += symbols[1:]
        at = np.minimum(self.pairs.searchsorted(keys), len(self.pairs) - 1)
        ranks = np.where(self.pairs[at] == keys, self.ranks[at], NEVER)
        ranks[lasts] = NEVER
        return at, ranks


class Counter:
    """Numbers of tokens of whole texts. What the chunks' memo holds in the place of ids is one number for each chunk."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.merger = RaggedMerger(self.vocabulary)
        self.chunked = Chunked(self._ask, self._words, list(self.vocabulary.added))

    def _ask(self, texts: list[str]) -> list[np.ndarray]:
        words, owner, totals = [], [], np.zeros(len(texts), np.uint32)
        for k, text in enumerate(texts):
            for word in self.vocabulary.pretokens(text):
                if isinstance(word, int):
                    totals[k] += 1
                else:
                    words.append(word.encode())
                    owner.append(k)
        np.add.at(totals, owner, self.merger.count(b"".join(words), np.fromiter(map(len, words), np.int64, len(words))).astype(np.uint32))
        return list(totals.reshape(-1, 1))

    def _words(self, data: bytes, sizes: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """A chunk of letters, with a space before it or none, is one pre-token."""
        return np.ones(len(sizes), np.int64), self.merger.count(data, sizes)

    def batch(self, texts: pa.Array | list[str]) -> np.ndarray:
        counts, sizes = self.chunked.batch(texts)
        total = np.r_[0, np.cumsum(counts.astype(np.int64))]
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit. A null text counts as empty: no bytes, no tokens. Repeated
    rows and rows with a null doc_id stay; other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        with own.chunked.task():
            for batch in batches:
                for part, texts in slices(batch, "text"):
                    n = pa.array(own.batch(texts), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.cast(pc.binary_length(texts), pa.int64()), n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return plain_docs(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
