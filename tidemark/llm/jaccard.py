"""Similarity join of documents on word n-grams, by count vectors: exact, without comparing all pairs.

A document is its set of n-grams, hashed. Sets with Jaccard similarity t or more differ in at most
D = (1 - t) / (1 + t) * (|A| + |B|) members. The steps:

1. Hash the members into groups, so that each document is a vector of group counts. Documents of like size use the same
   number of groups, D + 1 + spare, with D for two documents at the top of their size class; a document also takes part
   in the next classes if a partner may be there. At most D groups of a linked pair differ, so more than `spare` agree,
   and the fullest of these is among the D + 1 fullest groups of both documents: the groups' contents are keys, and
   linked documents share a key. Long shared passages alone seldom fill a whole group, so chance keys are few. In short
   documents all groups that agree may be empty ones. Then all filled groups of both differ, so both have D at most: a
   document with so few gives its least members as keys too, as many as it may lack in a partner and one more. Members
   before the least one that both have are not in the partner, so linked documents share that one.
   Some of the spare groups are keys too, so that linked documents share several (`Threshold.groups` says how many).
2. Keys of a few documents give pairs, which stay if they share as many keys as linked documents do; what a pair may share
   beyond those counts as shared. Of its more frequent keys a document drops its commonest, one less than linked documents
   share, so that the rarest one that these share stays; what is left of them is stars. So a passage that many documents
   have does not join them. Documents that are joined, directly or through others, form a cluster (connected components).
   No link leaves a cluster.
3. In each cluster, count vectors of another grouping are points of an R-tree. The sum of the smaller coordinates bounds
   the overlap of two documents, and that against a node's largest coordinates the overlap with all below it. Clusters
   over `LARGE` documents are first split by this bound alone, on vectors of `GROUPS` counts, so that chance keys never
   cost a shuffle of texts; what the bound leaves is verified on the sets themselves. Pairs already known to be connected
   are skipped, so only a forest of links leaves a task. Clusters are dealt out in blocks, every pair of blocks being one
   task's.
4. Connected components over the links.

Equal sets are found by a digest first and compared once. Texts are shuffled only for documents in clusters.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_filter, join_counted, numbered, plain_docs, settled, slices, table, tidy, written
from tidemark.llm.components import components
from tidemark.llm.textarrays import Words, mix, odd_numbers

#: Size classes grow by this factor.
CLASS = 1.3
#: Groups beyond D + 1, as a share of D + 1, and the part of these that are keys as well.
SPARE, MORE = 0.25, 3
#: Documents of a key that gives pairs, and low bits of a key, which are its size class.
FEW, CLASSES = 8, 64
#: Members of the documents in a block, and of the R-tree's nodes.
BLOCK, FANOUT = 1_500_000, 16
#: Documents of a cluster that is split by vectors first, coordinates of these, and documents in a block of it.
LARGE, GROUPS, VECTORS = 16, 256, 3_000


class Threshold:
    """Similarity of `num` / 100 or more, in whole numbers."""

    def __init__(self, num: int):
        self.num = num

    def linked(self, both: int, a: int, b: int) -> bool:
        return both > 0 and 100 * both >= self.num * (a + b - both)

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least size of the intersection of linked sets of these sizes."""
        return -(-(self.num * (a + b)) // (100 + self.num))

    def differ(self, total: int) -> int:
        """Members at most that two linked sets with `total` members do not share."""
        return (100 - self.num) * total // (100 + self.num)

    def groups(self, differ: int) -> tuple[int, int]:
        """Groups of a class with D = differ, and how many keys of the class two linked documents share at least, unless
        both have too few filled groups."""
        spare = math.ceil((differ + 1) * SPARE)
        return differ + 1 + spare, 1 + spare // MORE

    def classes(self, size: int) -> list[tuple[int, int]]:
        """(class, D) of all classes that a document of this size takes part in. Class c holds sizes over top(c-1)."""
        found, c = [], 0
        while _top(c) < size:
            c += 1
        while not found or 100 * size >= self.num * (_top(c - 1) + 1):
            found.append((c, self.differ(2 * _top(c))))
            c += 1
        return found


def _top(c: int) -> int:
    return -1 if c < 0 else int(4 * CLASS**c)


def sets_of(texts: pa.Array, n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, hashed and ascending, one text after another, and their numbers.

    A text with fewer words, but some, has its whole sequence as its one member.
    """
    words = Words(texts, lower)
    sizes = words.sizes()
    h = words.windows(n, 307)
    per = np.maximum(sizes - n + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), per)
    at = np.repeat(words.starts[:-1], per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    values = h[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        k = odd_numbers(n, 307)
        whole = [mix(np.array([sum((int(w) * int(c) for w, c in zip(words.hashes[words.starts[i] : words.starts[i + 1]], k, strict=False)), int(sizes[i])) % (1 << 64)], np.uint64))[0] for i in short]
        owner, values = np.r_[owner, short], np.r_[values, np.array(whole, np.uint64)]
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    keep = np.r_[True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])][: len(owner)]
    return values[keep], np.bincount(owner[keep], minlength=len(sizes))


def keys_of(values: np.ndarray, sizes: np.ndarray, limit: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the documents' fullest groups, and of the least members where few groups are filled, and the document that
    each is of. Values ascend in each document."""
    return _keys(values, sizes, limit)[:2]


def _keys(values: np.ndarray, sizes: np.ndarray, limit: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `keys_of`, and for each document the classes, as bits, in which few of its groups are filled. The low bits of a
    key are its class; classes beyond the last one count as that, of which linked documents share fewer keys."""
    known: dict[int, list[tuple[int, int]]] = {}
    doc, cls, differ = [], [], []
    for i, size in enumerate(sizes.tolist()):
        if size:
            for c, d in known.get(size) or known.setdefault(size, limit.classes(size)):
                if d:  # in classes where linked sets are equal, the digest has found them
                    doc.append(i)
                    cls.append(c)
                    differ.append(d)
    doc, cls, differ = np.array(doc, np.int64), np.array(cls, np.int64), np.array(differ, np.int64)
    groups, shared = np.array([limit.groups(d) for d in differ.tolist()], np.int64).reshape(-1, 2).T
    emit = differ + shared
    first = np.cumsum(groups) - groups
    starts = np.cumsum(sizes) - sizes
    per = sizes[doc]
    which = np.repeat(np.arange(len(doc)), per)
    members = values[np.repeat(starts[doc], per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)]
    total = int(groups.sum())
    at = ((members >> np.uint64(20)) % groups[which].astype(np.uint64)).astype(np.int64) + first[which]
    counts = np.bincount(at, minlength=total)
    mixed = mix(members)
    # Sums of 64-bit numbers modulo 2^64, from exact sums of their halves.
    low = np.bincount(at, (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(at, (mixed >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    owner = np.repeat(np.arange(len(doc)), groups)
    content = mix(low + (high << np.uint64(32)) + np.uint64(1))
    # The fullest groups of each document; equal groups of two documents stand in the same order, by count and content.
    order = np.lexsort((content, -counts, owner))
    rank = np.arange(total) - np.repeat(first, groups)
    chosen = order[(rank < emit[owner]) & (counts[order] > 0)]
    key = content[chosen] + (cls[owner[chosen]].astype(np.uint64) << np.uint64(40)) + (chosen - first[owner[chosen]]).astype(np.uint64)
    few = np.flatnonzero(np.bincount(owner[counts > 0], minlength=len(doc)) < emit)
    take = per[few] + (-limit.num * per[few]) // 100 + 1
    single = np.repeat(few, take)
    members = values[np.repeat(starts[doc[few]], take) + np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)]
    key = np.r_[key, mix(members + np.uint64(2)) + (cls[single].astype(np.uint64) << np.uint64(40))]
    low = np.minimum(cls, CLASSES - 1)
    own = np.r_[low[owner[chosen]], low[single]].astype(np.uint64)
    scarce = np.zeros(len(sizes), np.int64)
    np.bitwise_or.at(scarce, doc[few], np.left_shift(np.int64(1), low[few]))
    return ((mix(key) & np.uint64(~(CLASSES - 1) & 0xFFFFFFFFFFFFFFFF)) | own).view(np.int64), np.r_[doc[owner[chosen]], doc[single]], scarce


def _vectors(values: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """Members of each document by group, 32 bits each; None for documents without members here."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(owner * GROUPS + ((values >> np.uint64(7)) % np.uint64(GROUPS)).astype(np.int64), minlength=len(sizes) * GROUPS)
    rows = counts.astype("<u4").reshape(-1, GROUPS)
    return [rows[i].tobytes() if n else None for i, n in enumerate(sizes.tolist())]


def _digests(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = []
    for seed in (11, 13):
        total = np.r_[np.uint64(0), np.cumsum(mix(values + np.uint64(seed)))]
        ends = np.cumsum(sizes)
        sums.append(mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return sums[0], sums[1]


def signatures(docs: DataFrame, n: int, percent: int, lower: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, a digest of the set in two longs, the keys, and the classes with few filled groups; keys are null where the same batch has an
    equal set, whose first row stands for all, and where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = Threshold(percent)
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for part, texts in slices(batch, "text"):
                values, sizes = sets_of(texts, n, lower)
                d1, d2 = _digests(values, sizes)
                first = np.zeros(len(sizes), bool)
                for i, pair in enumerate(zip(d1.tolist(), d2.tolist(), strict=True)):
                    if sizes[i] and pair not in seen:
                        seen.add(pair)
                        first[i] = True
                keep = np.repeat(first, sizes)
                own = np.where(first, sizes, 0)
                keys, doc, scarce = _keys(values[keep], own, limit)
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(len(sizes) + 1)).astype(np.int32)
                vectors = _vectors(values[keep], own)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[order], pa.int64()), mask=pa.array(~first))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(d1), pa.array(d2), lists, pa.array(scarce), pa.array(vectors, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "keys", "scarce", "vector"])

    return plain_docs(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, scarce long, vector binary")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of key and id: the first id here of each key with each other one; and, with `key`, the first id
    of the first and of the last key, whose other rows may be in the partitions before and behind."""
    key = lead = None
    ends: dict[int, int] = {}
    for batch in batches:
        k, i = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if not len(k):
            continue
        new = np.r_[key is None or k[0] != key, k[1:] != k[:-1]]
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        leads = np.where(at >= 0, i[np.maximum(at, 0)], lead if lead is not None else 0)
        pairs = np.unique(np.stack([leads, i], 1)[leads != i], axis=0)
        key, lead = k[-1], leads[-1]
        if not ends:
            ends[int(k[0])] = int(i[0])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(pairs), pa.int64())], ["a", "b", "key"])
    if key is not None:
        ends.setdefault(int(key), int(lead))
        yield pa.RecordBatch.from_arrays([pa.array(list(ends.values()), pa.int64()), pa.nulls(len(ends), pa.int64()), pa.array(list(ends), pa.int64())], ["a", "b", "key"])


def _starred(spark: SparkSession, keys: DataFrame) -> DataFrame:
    """Pairs a, b that connect the ids of each key (rows of key and id). Rows are range-partitioned by key and id, so a key of
    many rows spans tasks, and what each of these has is joined by its first ids, two a partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = keys.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").mapInArrow(tidy(_stars), "a long, b long, key long")
    found = written(spark, found, "stars")
    ends = found.filter("key is not null").select("key", F.col("a").alias("b"))
    first = ends.groupBy("key").agg(F.min("b").alias("a"))
    return found.filter("key is null").select("a", "b").unionByName(ends.join(first, "key").filter("a <> b").select("a", "b"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of key and id: pairs a, b of the ids of each key of `FEW` rows at most, with its class and how
    often they were met here; and the rows of other keys, as a and key. The first and the last key are among these, since
    the partitions before and behind may have rows of them."""
    names = ["a", "b", "key", "n"]
    held_k, held_i = np.zeros(0, np.int64), np.zeros(0, np.int64)  # rows of the last key, which may go on
    first, passed = None, None  # the first key here, and one that is known to have more rows
    pairs: list[np.ndarray] = []

    def rows(k: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i), pa.nulls(len(i), pa.int64()), pa.array(k), pa.nulls(len(i), pa.int64())], names)

    def counted() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate([*pairs, np.zeros((0, 3), np.int64)]), axis=0, return_counts=True)
        pairs.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(found[:, c]) for c in range(3)), pa.array(n.astype(np.int64))], names)

    for batch in batches:
        k, i = np.r_[held_k, batch.column("key").to_numpy()], np.r_[held_i, batch.column("id").to_numpy()]
        if not len(k):
            continue
        first = int(k[0]) if first is None else first
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        lengths = np.diff(np.r_[starts, len(k)])
        many = (lengths > FEW) | (k[starts] == first)
        if passed is not None:
            many |= k[starts] == passed
        passed = int(k[-1]) if many[-1] else None
        out = np.repeat(many, lengths)
        if out.any():
            yield rows(k[out], i[out])
        open_ = len(k) if many[-1] else int(starts[-1])
        held_k, held_i = k[open_:], i[open_:]
        few = ~many
        few[-1] = False
        for m in range(2, FEW + 1):
            at = starts[few & (lengths == m)]
            if len(at):
                x, y = np.triu_indices(m, 1)
                ids = i[at[:, None] + np.arange(m)]
                two = np.stack([ids[:, x].ravel(), ids[:, y].ravel(), np.repeat(k[at] & (CLASSES - 1), len(x))], 1)
                pairs.append(two[two[:, 0] != two[:, 1]])
        if sum(map(len, pairs)) > 500_000:
            yield counted()
    if len(held_k):
        yield rows(held_k, held_i)
    yield counted()


def _joined(spark: SparkSession, keys: DataFrame, scarce: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b that connect what links connect, from rows of key and id. scarce: id, and the classes with few filled groups
    as bits."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = keys.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").mapInArrow(tidy(_met), "a long, b long, key long, n long")
    found = written(spark, found, "met")
    limit = Threshold(percent)
    shared = F.get(F.array(*[F.lit(limit.groups(limit.differ(2 * _top(c)))[1]) for c in range(CLASSES)]), F.col("class").cast("int"))
    bit = lambda c: (F.expr(f"shiftright({c}, cast(class as int)) & 1L") == 1)
    scarce = scarce.filter("scarce <> 0").groupBy("id").agg(F.bit_or("scarce").alias("scarce"))

    rows = found.filter("b is null").select(F.col("a").alias("id"), "key")
    total = rows.count()
    counts = written(spark, rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.count(F.lit(1)).alias("_n")), "counts", total)
    rows = join_counted(rows, counts, "key", total).withColumn("class", F.col("key").bitwiseAND(F.lit(CLASSES - 1)))
    rows = rows.join(scarce, "id", "left").withColumn("scarce", F.coalesce(bit("scarce"), F.lit(False)))
    own = Window.partitionBy("id", "class")  # keys of one document
    rows = rows.withColumn("_rn", F.row_number().over(own.orderBy(F.desc("m"), "key")))
    rows = written(spark, rows.select("id", "class", "key", (F.col("scarce") | (F.col("_rn") >= shared)).alias("stays")), "rows", total)
    stars = _starred(spark, rows.filter("stays").select("key", "id"))

    pairs = found.filter("b is not null").groupBy("a", "b", F.col("key").alias("class")).agg(F.sum("n").alias("n"))
    pairs = written(spark, pairs.withColumn("enough", F.col("n") >= shared), "pairs")
    # What is beyond the pairs' keys: frequent keys of both, and documents of which both have few filled groups.
    more = rows.groupBy("id", "class").agg(F.count(F.lit(1)).alias("many"))
    each = scarce.select("id", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))).alias("class"), "scarce").filter(bit("scarce")).select("id", F.col("class").cast("long").alias("class"))
    more = written(spark, more.join(each.withColumn("scarce", F.lit(True)), ["id", "class"], "full").select("id", "class", F.coalesce("many", F.lit(0)).alias("many"), F.coalesce("scarce", F.lit(False)).alias("scarce")), "more")
    side = lambda c: more.select(F.col("id").alias(c), "class", F.col("many").alias(f"many_{c}"), F.col("scarce").alias(f"scarce_{c}"))
    unsure = pairs.filter("not enough").join(side("a"), ["a", "class"]).join(side("b"), ["b", "class"])
    unsure = unsure.filter((F.col("scarce_a") & F.col("scarce_b")) | (F.col("n") + F.least("many_a", "many_b") >= shared))
    return pairs.filter("enough").select("a", "b").unionByName(unsure.select("a", "b")).unionByName(stars)


def _dealt(rows: DataFrame, blocks: DataFrame, total: int, *columns: str) -> DataFrame:
    """Every document meets each block of its cluster once: (low block, high block) is a task, and `side` tells which of
    the two the document is of. total: rows, of which each cluster has `_n`."""
    return (
        join_counted(rows, blocks, "cluster", total)
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .selectExpr("doc_id", "cluster", *columns, "least(own, other) AS i", "greatest(own, other) AS j", "cast(own > other as int) AS side")
    )


def _split(spark: SparkSession, clusters: DataFrame, marked: DataFrame, percent: int, several: int) -> DataFrame:
    """Clusters (of `several` documents in all) with the large ones replaced by what the bound on the overlap of vectors connects in them."""
    counts = written(spark, clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")), "sizes", several)
    large = counts.filter(F.col("_n") > LARGE).withColumn("blocks", F.ceil(F.col("_n") / VECTORS).cast("int"))
    vectors = marked.filter("vector is not null").select("doc_id", F.col("n_shingles").alias("size"), "vector").dropDuplicates(["doc_id"])
    dealt = _dealt(clusters.join(vectors, "doc_id"), large, several, "size", "vector")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        limit, order = Threshold(percent), np.argsort(group.column("doc_id").to_numpy(), kind="stable")
        ids, sizes, side = (group.column(c).to_numpy()[order] for c in ("doc_id", "size", "side"))
        points = np.frombuffer(b"".join(group.column("vector").to_pylist()), "<u4").reshape(-1, GROUPS)[order]
        found = _forest(points, sizes, ids.tolist(), side, limit, lambda i, j: True)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    pairs = dealt.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")
    parts = components(spark, pairs).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "cluster")
    small = join_counted(clusters, large, "cluster", several, "left").filter("blocks is null")
    return small.select("doc_id", "cluster").unionByName(parts.select("doc_id", "cluster"))


class Tree:
    """A packed R-tree over count vectors. Its nodes keep the largest count of each coordinate and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Packed in the order of size, then of the fullest coordinate: leaves hold documents that may be linked.
        self.order = np.lexsort((points.argmax(1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        level = (self.points, self.sizes, self.sizes)
        self.levels = [level]
        while len(level[0]) > FANOUT:
            cut = np.arange(0, len(level[0]), FANOUT)
            level = (np.maximum.reduceat(level[0], cut), np.minimum.reduceat(level[1], cut), np.maximum.reduceat(level[2], cut))
            self.levels.append(level)

    def near(self, point: np.ndarray, size: int, limit: Threshold) -> np.ndarray:
        """Points whose summed coordinate minima with `point` allow a link, by their places in what the tree was made of."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            most, low, high = (x[at] for x in self.levels[k])
            fits = (100 * high >= limit.num * size) & (limit.num * low <= 100 * size)
            at, most, low = at[fits], most[fits], low[fits]
            bound = np.minimum(most, point).sum(1, dtype=np.int64)
            at = at[bound >= limit.overlap(size, low)]
            if k:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[k - 1][0])]
        return self.order[at]


def _forest(points: np.ndarray, sizes: np.ndarray, ids: list[int], side: np.ndarray, limit: Threshold, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs that the bound leaves and `linked` confirms, as few as connect what all of them connect. side: 0 or 1; in a
    task of two blocks, pairs within one are another task's (all 0: all pairs)."""
    across = side.any() and not side.all()
    label, out = np.arange(len(ids)), []
    members = [[i] for i in range(len(ids))]  # of each label; the smaller set takes the larger one's label
    tree = Tree(points, sizes)
    for i in range(len(ids)):
        if across and side[i]:
            continue
        if len(members[label[i]]) == len(ids):
            break
        near = tree.near(points[i], sizes[i], limit)
        near = near[(side[near] == 1) if across else (near > i)]
        for j in near[label[near] != label[i]].tolist():
            if label[j] != label[i] and linked(i, j):
                out.append((ids[i], ids[j]))
                small, large = sorted((int(label[i]), int(label[j])), key=lambda x: len(members[x]))
                label[members[small]] = large
                members[large] += members[small]
                members[small] = []
    return out


def links_among(sets: list[np.ndarray], ids: list[int], side: list[int], limit: Threshold) -> list[tuple[int, int]]:
    """A forest of links that connects what the links among these sets connect."""
    sizes = np.array([len(s) for s in sets])
    groups = int(min(2048, max(16, 1 << int(np.ceil(np.log2(2 * np.median(sizes) + 1))))))
    points = np.stack([np.bincount((s >> np.uint64(7)).astype(np.int64) & (groups - 1), minlength=groups) for s in sets]).astype(np.uint32)

    def linked(i: int, j: int) -> bool:
        return limit.linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), sizes[i], sizes[j])

    return _forest(points, sizes, ids, np.array(side), limit, linked)


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    A null text counts as empty; it has no members and no links. Rows without a doc_id link with nothing and have no
    component_id. Rows that share a doc_id are one document to the links, and each is given back. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    return settled(spark, lambda: _near_groups(spark, plain_docs(docs, doc_id, text), n, percent, lower), "near")


def _near_groups(spark: SparkSession, plain: DataFrame, n: int, percent: int, lower: bool) -> DataFrame:
    every = written(spark, signatures(plain, n, percent, lower), "signatures")
    marked, plain = every.filter("doc_id is not null"), plain.filter("doc_id is not null")
    sets = marked.select("doc_id", "n_shingles", "d1", "d2")

    keys = marked.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    scarce = marked.select(F.col("doc_id").alias("id"), "scarce")
    clusters = components(spark, _joined(spark, keys, scarce, percent)).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "cluster")

    several = clusters.count()
    clusters = written(spark, _split(spark, clusters, marked, percent, several), "parts", several)
    links = written(spark, _verified(plain, clusters, sets, n, percent, lower), "links", several)
    # Equal sets count as their smallest document; a link of one is a link of all.
    some = sets.filter("n_shingles > 0")
    lowest = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    lowest = written(spark, lowest.withColumn("both", F.struct("d1", "d2")).drop("d1", "d2"), "lowest")
    total = lowest.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    copies = join_counted(some.select("doc_id", F.struct("d1", "d2").alias("both")), lowest, "both", total).filter("doc_id <> low").select("doc_id", "low")
    copies = written(spark, copies, "copies", total)
    low = lambda c: links.join(copies.withColumnsRenamed({"doc_id": c, "low": f"low_{c}"}), c, "left").withColumn(c, F.coalesce(f"low_{c}", c)).drop(f"low_{c}")
    links = low("a")
    links = low("b")
    # A document of several rows may have copies of several sets, which it connects.
    several = copies.groupBy("doc_id").agg(F.min("low").alias("a"), F.max("low").alias("z")).filter("a <> z")
    links = links.unionByName(copies.join(several, "doc_id").selectExpr("a", "low AS b"))
    found = components(spark, links).withColumnRenamed("node", "low")
    return (
        sets.select("doc_id", "n_shingles")
        .join(copies.dropDuplicates(["doc_id"]), "doc_id", "left")
        .withColumn("low", F.coalesce("low", "doc_id"))
        .join(found, "low", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "low").alias("component_id"))
        .unionByName(every.filter("doc_id is null").selectExpr("doc_id", "n_shingles", "doc_id AS component_id"))
    )


def _verified(plain: DataFrame, clusters: DataFrame, sets: DataFrame, n: int, percent: int, lower: bool) -> DataFrame:
    """Links a, b of documents in one cluster."""
    sized = clusters.join(sets.select("doc_id", "n_shingles").dropDuplicates(["doc_id"]), "doc_id")
    blocks = sized.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("_n"))
    total = clusters.count()
    blocks = written(clusters.sparkSession, blocks, "blocks", total)
    dealt = _dealt(sized.select("doc_id", "cluster"), blocks, total)
    wanted = bounded_filter(plain, clusters.select(F.col("doc_id").alias("key")), F.col("doc_id")).filter("maybe").select("doc_id", "text")
    rows = wanted.join(dealt, "doc_id")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        limit, sets_, ids, sides = Threshold(percent), [], [], []
        for batch in group.combine_chunks().to_batches():
            for part, texts in slices(batch, "text"):
                values, sizes = sets_of(texts, n, lower)
                ends = np.cumsum(sizes)
                sets_ += [values[a:b] for a, b in zip(ends - sizes, ends, strict=True)]
                ids += part.column("doc_id").to_pylist()
                sides += part.column("side").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: ids[k])
        found = links_among([sets_[k] for k in order], [ids[k] for k in order], [sides[k] for k in order], limit)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, lower: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without near copies, with all their columns: of each component the row with the smallest id.

    Where ids repeat or are null, rows are told apart by their place in the order of ids (null last), so each text is
    judged by itself, and one row of each component stays. Texts without words all stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = numbered(docs.toDF(*names), names[docs.columns.index(doc_id)])
    gone = near_groups(rows, n, percent, lower, "_row", names[docs.columns.index(text)]).filter("doc_id <> component_id").select(F.col("doc_id").alias("key"))
    gone = written(spark, gone, "gone")
    marked = bounded_filter(rows, gone, F.col("_row"))
    checked = marked.filter("maybe").join(gone, F.col("_row") == gone["key"], "left_anti")
    return marked.filter("not maybe").select(*names).unionByName(checked.select(*names)).toDF(*docs.columns)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = a GROUP BY a
"""
