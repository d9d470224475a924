"""Ranked lexical search as a blocked product of sparse matrices: items by terms, times terms by documents.

The items are taken in blocks of about `ITEM_BYTES` of text, whose terms are the columns that matter; only these reach the
tasks. One pass over the documents counts each document's terms and writes its row of term frequencies (the documents'
side of the matrix). Statistics come from that table. A second pass turns rows into int64 impacts, a block of documents
at a time, sorted by term; the rows of an item's terms are merged into one accumulator (Gustavson's row-wise product), and
a block's best documents are reduced with the best so far. Each task's best, `k` an item, meet in rounds of `FAN` tasks.

Terms are told apart by a 64-bit hash that leads to one candidate, whose bytes are then compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settled, slices, table, tidy, written
from tidemark.llm.textarrays import Words

#: Bytes of item texts in a block, on average; the terms of a block reach every task.
ITEM_BYTES = 4 << 20
#: Documents that are scored at once.
DOCUMENTS = 8_192
#: Tasks whose best rows meet in one group of a round.
FAN = 64

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Terms(Words):
    """Terms of texts: runs of letters, digits and all that is not ASCII, with A-Z in lower case."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, lower=True, word=_WORD)
        self.lengths = self.stops - self.begins
        self.low = np.concatenate([_LOWER[self.bytes], np.zeros(8, np.uint8)])
        self.eights = np.lib.stride_tricks.as_strided(self.low[:8].view("<u8"), (len(self.bytes) + 1,), (1,)) if len(self.bytes) else np.zeros(1, np.uint64)

    def piece(self, rows: np.ndarray, at: int) -> np.ndarray:
        """Bytes `at` to `at` + 7 of each term, as numbers; what lies behind the term is 0."""
        left = np.clip(self.lengths[rows] - at, 0, 8).astype(np.uint64)
        mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8)) % np.uint64(64)) - np.uint64(1))
        return self.eights[np.minimum(self.begins[rows] + at, len(self.eights) - 1)] & mask


class Vocabulary:
    """Distinct terms, numbered in the order of their hashes."""

    def __init__(self, terms: list[str]):
        found = Terms(pa.array(sorted(set(terms)), pa.string()))
        if len(found.hashes) != len(set(terms)):
            raise ValueError("a term of an item is not one term")
        order = np.argsort(found.hashes, kind="stable")
        self.hashes, self.lengths = found.hashes[order], found.lengths[order]
        if len(order) and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms have one hash")
        self.pieces = [found.piece(order, at) for at in range(0, int(self.lengths.max(initial=0)), 8)]
        texts = sorted(set(terms))
        self.number = {texts[i]: n for n, i in enumerate(order.tolist())}

    def lookup(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms that are in the vocabulary, and their numbers."""
        if not len(self.hashes) or not len(terms.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, terms.hashes), len(self.hashes) - 1)
        rows = np.flatnonzero((self.hashes[at] == terms.hashes) & (self.lengths[at] == terms.lengths))
        at = at[rows]
        for i, piece in enumerate(self.pieces):
            open_ = np.flatnonzero(self.lengths[at] > 8 * i)
            wrong = open_[piece[at[open_]] != terms.piece(rows[open_], 8 * i)]
            if len(wrong):
                rows, at = np.delete(rows, wrong), np.delete(at, wrong)
        return rows, at


@dataclass
class Items:
    """A block of items: the terms of item i are `terms[starts[i]:starts[i + 1]]`, numbers of `vocabulary`."""

    ids: list
    starts: np.ndarray
    terms: np.ndarray
    vocabulary: Vocabulary


def item_blocks(items: DataFrame, item_id: str, text: str, size: int | None = None) -> Iterator[Items]:
    """The items in blocks that are dealt by a hash of their id, so that a block holds about `size` bytes of text. Rows with
    one id are one item with the terms of all."""
    size = size or ITEM_BYTES
    n = items.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0] // size + 1
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    pairs = items.select(F.col(item_id).alias("id"), F.explode(found).alias("term")).distinct()
    for block in range(n):
        mine = pairs if n == 1 else pairs.filter(F.pmod(F.xxhash64("id"), F.lit(n)) == block)
        rows = sorted(mine.collect(), key=lambda r: (r.id is None, r.id))  # about `size` bytes
        if rows:
            vocabulary = Vocabulary([r.term for r in rows])
            ids = list(dict.fromkeys(r.id for r in rows))
            place = {x: i for i, x in enumerate(ids)}
            owners = np.array([place[r.id] for r in rows])
            yield Items(ids, np.searchsorted(owners, np.arange(len(ids) + 1)), np.array([vocabulary.number[r.term] for r in rows]), vocabulary)


ROWS = "doc_id long, n long, terms array<int>, counts array<int>"


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (those in the vocabulary) of each document with a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield _row_block(part.column("doc_id"), Terms(texts), known.value)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), ROWS)


def _row_block(ids: pa.Array, terms: Terms, vocabulary: Vocabulary) -> pa.RecordBatch:
    n = terms.sizes()
    rows, at = vocabulary.lookup(terms)
    owner = np.searchsorted(terms.starts, rows, "right") - 1
    pairs, counts = np.unique(owner * np.int64(max(1, len(vocabulary.hashes))) + at, return_counts=True)
    owner, at = np.divmod(pairs, max(1, len(vocabulary.hashes)))
    some = np.flatnonzero(n)
    bounds = pa.array(np.append(np.searchsorted(owner, some), len(owner)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (at, counts)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(n[some], pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


BEST = "task long, item long, score long, doc_id long"


def _best(rows: DataFrame, items: Items, weight: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """Each task's `k` best documents of each item."""
    shared = rows.sparkSession.sparkContext.broadcast((items.starts, items.terms, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, terms, weight = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (len(starts) - 1)
        none = np.iinfo(np.int64).max  # a null id comes last among equal scores
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS):
                block = batch.slice(at, DOCUMENTS)
                ids = block.column("doc_id").fill_null(none).to_numpy(zero_copy_only=False)
                begins, documents, impacts = _columns(block, weight, total, length)
                for i in range(len(best)):
                    sums = np.zeros(block.num_rows, np.int64)
                    for t in terms[starts[i] : starts[i + 1]]:
                        own = slice(begins[t], begins[t + 1])
                        sums[documents[own]] += impacts[own]  # a document occurs once a term
                    least = best[i][0][-1] if len(best[i][0]) == k else 1
                    found = np.flatnonzero(sums >= max(1, least))
                    if len(found):
                        scores, who = np.concatenate([best[i][0], sums[found]]), np.concatenate([best[i][1], ids[found]])
                        order = np.lexsort((who, -scores))[:k]
                        best[i] = scores[order], who[order]
        sizes = [len(s) for s, _ in best]
        if sum(sizes):
            who = np.concatenate([d for _, d in best])
            columns = [pa.array(np.full(sum(sizes), TaskContext.get().partitionId()), pa.int64()), pa.array(np.repeat(np.arange(len(best)), sizes), pa.int64())]
            columns += [pa.array(np.concatenate([s for s, _ in best]), pa.int64()), pa.array(who, pa.int64(), mask=who == none)]
            yield pa.RecordBatch.from_arrays(columns, ["task", "item", "score", "doc_id"])

    return rows.mapInArrow(tidy(run), BEST)


def _columns(block: pa.RecordBatch, weight: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's matrix by term: where each term's entries begin, their documents, and their weighted impacts."""
    n = block.column("n").to_numpy().astype(np.int64)
    lists = block.column("terms")
    term, tf = lists.flatten().to_numpy().astype(np.int64), block.column("counts").flatten().to_numpy().astype(np.int64)
    document = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
    m = 10 + 90 * n * total // length
    impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[document]))
    order = np.argsort(term, kind="stable")
    return np.searchsorted(term[order], np.arange(len(weight) + 1)), document[order], impact[order]


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: of each item the `k` documents with the highest scores above 0, equal ones by id (null
    last; rows with one id in some order). A term's weight falls with the documents that hold it, its impact grows with its
    occurrences and falls with the document's length; the score sums weight times impact over the item's distinct terms.

    A null text has no terms; items without terms, and empty tables, give no rows. Other columns are ignored, whatever their
    names. All sums are 64-bit: 90 * terms of a document * documents must stay below 2**63.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = items.schema[item_id].dataType.simpleString()

    def built() -> DataFrame:
        parts = [_of_block(spark, plain, block, k, kind) for block in item_blocks(items, item_id, item_text)]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")

    return settled(spark, built, "ranked")


def _of_block(spark: SparkSession, docs: DataFrame, block: Items, k: int, kind: str) -> DataFrame:
    rows = written(spark, frequencies(docs, block.vocabulary), "frequencies")
    total, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(block.vocabulary.hashes), np.int64)
    for term, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the block's terms at most
        df[term] = n
    best = written(spark, _best(rows, block, weights(df, total), total, max(1, length), k), "best")
    most = best.agg(F.max("task")).first()[0] or 0
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    while most:  # k rows an item from each of FAN tasks at a time
        most //= FAN
        best = best.withColumn("task", F.expr(f"task div {FAN}"))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "task").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {kind}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of the whole table for each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
 FROM i JOIN tf USING (term) JOIN w USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
