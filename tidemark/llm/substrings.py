"""Substring dedup on a compacted de Bruijn graph of token k-mers.

The edges of the graph are the k-mers of `WINDOW` words, its nodes the sequences of one word less. As in other builders
of such graphs, edges are dealt by a minimizer, the `EDGE` words with the smallest hash among them, so that equal edges
meet wherever they stand, and a run of neighbouring edges with one minimizer occurrence travels as one row, a path.

1. Draw: documents become paths (minimizer, hash of the path, document, first word, edges, the path before). A batch
   compacts what it holds, so a passage in a third of all documents travels to its minimizer once per batch.
2. Meet: one shuffle by minimizer brings all occurrences together. Paths that occur once are no repeats and end there.
   Where one minimizer has several paths, these branch: their edges are then compared one by one, by a join on hashes.
3. Compact: what repeats are the nodes of a condensed graph, one for each path or single edge that occurs several times.
   Counts tell where all occurrences of a node are followed by those of one other and preceded by none else; such
   nonbranching links are joined with themselves, doubling what a pointer skips, until each head knows its path's length.
4. Verify: the occurrences of each compacted path are looked up in the source texts by document and first word, and a
   digest of the words themselves decides which are equal. All but the first of these are repeats.

Results do not depend on hashes of step 1 to 3 beyond this: equal words always meet, and words that only share a hash are
told apart in step 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_filter, join_counted, numbered, plain_docs, settled, slices, table, tidy, written
from tidemark.llm.textarrays import Words, mix, odd_numbers

#: Words of an edge of the graph, and of the minimizer that deals edges out.
WINDOW, EDGE = 20, 8
#: REPEAT: an occurrence of a path that an earlier row has too. PATH: the first occurrence in a batch. FIRST: the first
#: of all occurrences of a path that has several. BRANCH: the first of a path beside which its minimizer has others.
REPEAT, PATH, FIRST, BRANCH = 0, 1, 2, 3
#: n: edges, from the one that starts at word `start`; prev: the path before in the document, 0 if none; times:
#: occurrences in the batch.
SCHEMA = "kind byte, edge long, path long, doc_id long, start long, n int, prev long, times int"
COLUMNS = ("edge", "path", "doc_id", "start", "n", "prev", "times")


def paths_of(words: Words, doc_ids: np.ndarray, window: int = WINDOW, edge: int = EDGE) -> dict[str, np.ndarray]:
    """One row for each run of windows of one document that draw one edge occurrence."""
    per = window - edge + 1
    h = words.windows(edge, 101)
    sizes = words.sizes()
    windows = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    first = np.cumsum(windows) - windows
    start = np.arange(int(windows.sum())) - np.repeat(first, windows) if len(sizes) else np.zeros(0, np.int64)
    place = np.repeat(words.starts[:-1], windows) + start  # of the window among all words
    if not len(place):
        return {c: np.zeros(0, np.int64) for c in COLUMNS}
    drawn = np.lib.stride_tricks.sliding_window_view(h, per).argmin(1)[place] + place
    new = np.r_[True, (drawn[1:] != drawn[:-1]) | (owner[1:] != owner[:-1])]
    runs = np.flatnonzero(new)
    n = np.diff(np.r_[runs, len(place)])
    # The path's hash is a sum over its words times powers, so a prefix sum gives it; its length and the edge's place
    # in it are mixed in.
    base = int(odd_numbers(1, 7)[0])
    steps = np.full(len(words.hashes) + 1, base, np.uint64)
    steps[0] = 1
    up = np.cumprod(steps)
    steps[1:] = pow(base, -1, 1 << 64)
    down = np.cumprod(steps)
    prefix = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(mix(words.hashes + np.uint64(3)) * up[:-1], out=prefix[1:])
    begin, stop = place[runs], place[runs] + n + window - 1
    shape = (n * (window + 1) + drawn[runs] - begin).astype(np.uint64)
    path = mix((prefix[stop] - prefix[begin]) * down[begin] + shape * np.uint64(0x9E3779B97F4A7C15))
    edge, path = h[drawn[runs]].view(np.int64), path.view(np.int64)
    name = names_of(edge, path)
    prev = np.where(np.r_[False, owner[runs][1:] == owner[runs][:-1]], np.r_[0, name[:-1]], 0)
    return {"edge": edge, "path": path, "doc_id": doc_ids[owner[runs]], "start": start[runs], "n": n, "prev": prev, "times": np.ones(len(n), np.int64)}


def names_of(edge: np.ndarray, path: np.ndarray) -> np.ndarray:
    """One number, not 0, for a minimizer and a path."""
    return (mix(edge.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ path.view(np.uint64)) | np.uint64(1)).view(np.int64)


def _batch(kind: np.ndarray | int, rows: dict[str, np.ndarray], pick: np.ndarray) -> pa.RecordBatch:
    kinds = np.full(len(pick), kind, np.int8) if isinstance(kind, int) else kind
    types = {"n": pa.int32(), "times": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(rows[c][pick], types.get(c, pa.int64())) for c in COLUMNS)], ["kind", *COLUMNS])


def draw(batches: Iterator[pa.RecordBatch], window: int = WINDOW, edge: int = EDGE) -> Iterator[pa.RecordBatch]:
    """From documents to paths; of those that repeat in a batch only the first goes to its minimizer. The others are
    REPEAT rows at once: `path` is then the path's name, and `edge` a number that spreads them."""
    for batch in batches:
        whole: dict[str, list[np.ndarray]] = {c: [] for c in COLUMNS}
        for part, texts in slices(batch, "text"):
            found = paths_of(Words(texts), part.column("doc_id").to_numpy(), window, edge)
            for c, x in whole.items():
                x.append(found[c])
        rows = {c: np.concatenate([np.zeros(0, np.int64), *x]) for c, x in whole.items()}
        order = np.lexsort((rows["start"], rows["doc_id"], rows["path"], rows["edge"]))
        e, p = rows["edge"][order], rows["path"][order]
        heads = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (p[1:] != p[:-1])][: len(order)])
        rows["times"][order[heads]] = np.diff(np.r_[heads, len(order)])
        first = np.zeros(len(order), bool)
        first[order[heads]] = True
        later = ~first
        rows["path"][later] = names_of(rows["edge"][later], rows["path"][later])
        rows["edge"][later] = mix((rows["doc_id"][later] * 1_000_003 + rows["start"][later]).view(np.uint64)).view(np.int64)
        yield _batch(np.where(first, PATH, REPEAT).astype(np.int8), rows, np.arange(len(order)))


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of minimizer, path, document and start: REPEAT and FIRST rows of the paths that occur several
    times, `path` being their names, and BRANCH rows. Holds one batch and two rows at a time."""
    edge = path = None
    alone = None  # the first row of the last path, until it is known whether the path repeats
    only = None  # the first path of the minimizer, until it is known whether there is another
    for batch in batches:
        rows = {c: batch.column(c).to_numpy().copy() for c in COLUMNS}
        kind = batch.column("kind").to_numpy()
        if (known := np.flatnonzero(kind == REPEAT)).size:
            yield _batch(REPEAT, rows, known)
        at = np.flatnonzero(kind == PATH)
        if not len(at):
            continue
        e, p = rows["edge"][at], rows["path"][at]
        new_edge = np.r_[edge is None or e[0] != edge, e[1:] != e[:-1]]
        new_path = new_edge | np.r_[path is None or p[0] != path, p[1:] != p[:-1]]
        rows["path"][at] = names_of(e, p)
        if alone is not None and not new_path[0]:
            yield alone
            alone = None
        if (~new_path).any():
            yield _batch(REPEAT, rows, at[~new_path])
        if only is not None and not new_edge[0] and new_path.any() and not new_edge[: new_path.argmax() + 1].any():
            yield only
            only = None
        heads = np.flatnonzero(new_path)
        if len(heads):
            several = (np.diff(np.r_[heads, len(at)]) > 1) | (rows["times"][at[heads]] > 1)
            if several.any():
                yield _batch(FIRST, rows, at[heads[several]])
            alone = None if several[-1] else _batch(FIRST, rows, at[heads[-1:]])
            # A head branches if the head before or after it has its minimizer.
            same = ~new_edge[heads]
            branch = same | np.r_[same[1:], False]
            if branch.any():
                yield _batch(BRANCH, rows, at[heads[branch]])
            only = None if branch[-1] else _batch(BRANCH, rows, at[heads[-1:]])
        edge, path = e[-1], p[-1]


def repeated_spans(docs: DataFrame, window: int = WINDOW, edge: int = EDGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, stop (words, stop exclusive) of spans whose windows all start earlier too, by document and word.

    Spans of one document may overlap. A null text counts as empty; documents with fewer words than a window have no
    spans. Each row needs a doc_id of its own, which gives the order (`without_repeats` sees to that); rows without one
    are left out. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = plain_docs(docs, doc_id, text).filter("doc_id is not null")
    return settled(spark, lambda: _verified(plain, _compacted(spark, _occurrences(spark, plain, window, edge)), window), "spans")


def _occurrences(spark: SparkSession, plain: DataFrame, window: int, edge: int) -> DataFrame:
    """name, doc_id, start, n, prev of all occurrences of paths, or of single edges where paths branch, that repeat."""
    drawn = plain.mapInArrow(tidy(lambda it: draw(it, window, edge)), SCHEMA)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = drawn.repartition(parts, "edge").sortWithinPartitions("edge", "path", "doc_id", "start").mapInArrow(tidy(meet), SCHEMA)
    met = written(spark, met, "paths")
    paths = met.filter(f"kind IN ({REPEAT}, {FIRST})").selectExpr("path AS name", "doc_id", "start", "n", "prev")

    branches = written(spark, met.filter(f"kind = {BRANCH}").select("edge", "doc_id", "start", "n"), "branches")
    sources = bounded_filter(plain, branches.select(F.col("doc_id").alias("key")), F.col("doc_id")).filter("maybe").drop("maybe")
    wanted = branches.groupBy("doc_id").agg(F.collect_list(F.struct("edge", "start", "n")).alias("paths"))  # at most one document's
    edges = sources.join(wanted, "doc_id").mapInArrow(tidy(lambda it: _edges(it, window)), "name long, doc_id long, start long, prev long")
    edges = written(spark, edges, "edges")
    times = written(spark, edges.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "times")
    single = join_counted(edges, times.withColumn("n", F.lit(1)), "name", edges.count()).select("name", "doc_id", "start", "n", "prev")
    return written(spark, paths.unionByName(single), "occurrences")


def _compacted(spark: SparkSession, occurrences: DataFrame) -> DataFrame:
    """name, doc_id, start, n of the occurrences of each maximal nonbranching path: of its head, with all its edges."""
    several = occurrences.count()
    nodes = written(spark, occurrences.groupBy("name").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("n")), "nodes", several)
    several = nodes.count()
    links = occurrences.filter("prev <> 0 AND prev <> name").groupBy("prev", "name").agg(F.count(F.lit(1)).alias("times"))
    links = links.join(nodes.selectExpr("name AS prev", "times"), ["prev", "times"]).join(nodes.select("name", "times"), ["name", "times"])
    links = written(spark, links.select("prev", "name"), "links", several)
    # Of each linked node: the node that its pointer has reached, and the edges in between.
    part = nodes.join(links.selectExpr("prev AS name", "name AS next"), "name", "left").selectExpr("name", "next", "cast(n as long) AS length")
    part = written(spark, part.join(links.selectExpr("prev AS name").union(links.select("name")).distinct(), "name"), "pointers", several)
    left, before = part.filter("next is not null").count(), -1
    while left and left != before:  # what never ends is a cycle
        far = part.selectExpr("name AS next", "next AS far", "length AS more")
        part = written(spark, part.join(far, "next", "left").selectExpr("name", "far AS next", "length + coalesce(more, 0L) AS length"), "pointers", several)
        left, before = part.filter("next is not null").count(), left
    inner = links.select("name").distinct()
    heads = part.filter("next is null").join(inner, "name", "left_anti").select("name", "length")
    units = (
        nodes.join(heads, "name", "left")
        .join(part.filter("next is not null").selectExpr("name", "true AS cycle"), "name", "left")
        .join(inner.selectExpr("name", "true AS inside"), "name", "left")
        .filter("cycle OR inside is null")
        .selectExpr("name", "times AS _n", "cast(coalesce(length, n) as int) AS edges")
    )
    units = written(spark, units, "units", several)
    return join_counted(occurrences, units, "name", occurrences.count()).selectExpr("name", "doc_id", "start", "edges AS n")


def _verified(plain: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """doc_id, start, stop of the occurrences whose words, read at their coordinates, an earlier occurrence has too."""
    spark = plain.sparkSession
    found = written(spark, found, "found")
    sources = bounded_filter(plain, found.select(F.col("doc_id").alias("key")), F.col("doc_id")).filter("maybe").drop("maybe")
    wanted = found.groupBy("doc_id").agg(F.collect_list(F.struct("name", "start", "n")).alias("paths"))  # at most one document's
    seen = sources.join(wanted, "doc_id").mapInArrow(tidy(lambda it: _digests(it, window)), "words binary, doc_id long, start long, stop long")
    seen = written(spark, seen, "seen")
    firsts = seen.groupBy("words").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    total = seen.count()
    return join_counted(seen, written(spark, firsts, "firsts", total), "words", total).filter("struct(doc_id, start) > first").select("doc_id", "start", "stop")


def _lists(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The row that each member of the lists in `paths` is of, and the members."""
    paths = part.column("paths")
    return np.repeat(np.arange(len(paths)), np.diff(paths.offsets.to_numpy())), paths.flatten()


def _edges(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The single edges of paths, each with the one before it in its path."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            words = Words(texts)
            hashes = words.windows(window, 211).view(np.int64)
            owner, flat = _lists(part)
            edge, start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("edge", "start", "n"))
            each = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            starts = start[each] + inside
            name = names_of(edge[each], hashes[words.starts[owner[each]] + starts]) if len(each) else np.zeros(0, np.int64)
            prev = np.where(inside > 0, np.r_[0, name[:-1]], 0) if len(each) else name
            rows = [name, part.column("doc_id").to_numpy()[owner[each]], starts, prev]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["name", "doc_id", "start", "prev"])


def _digests(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A digest of the words of each occurrence, and where they stand."""
    for batch in batches:
        for part, texts in slices(batch, "text"):
            owner, flat = _lists(part)
            start = flat.field("start").to_numpy(zero_copy_only=False)
            stop = start + flat.field("n").to_numpy(zero_copy_only=False) + window - 1
            digest, words, last = [], [], -1
            raw = texts.cast(pa.binary())
            for k, a, b in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True):
                if k != last:
                    words, last = raw[k].as_py().split(), k  # bytes split at 0x20 and 0x09-0x0D
                digest.append(hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest())
            doc = part.column("doc_id").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), *(pa.array(x, pa.int64()) for x in (doc, start, stop))], ["words", "doc_id", "start", "stop"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "text"):
            n_words, n_removed, digest, kept = [], [], [], []
            spans = part.column("spans").to_pylist()
            for text, own in zip(texts.cast(pa.binary()).to_pylist(), spans, strict=True):
                words = text.split()  # bytes split at 0x20 and 0x09-0x0D
                n_words.append(len(words))
                if own:
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, [s["start"] for s in own], 1)
                    np.add.at(gone, [s["stop"] for s in own], -1)
                    words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, window: int = WINDOW, edge: int = EDGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space).

    A null text has no words. Rows that share a doc_id, or have none (they come last), are told apart by their place in
    the order of doc_id, so repeated rows repeat each other. Other columns are ignored, whatever their names; an empty
    table gives no rows. Texts without repeats stay where they are read; only those that may have some meet their spans in
    a join.
    """
    plain = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id")
    spans = repeated_spans(plain, window, edge, "_row")
    per_doc = spans.groupBy(F.col("doc_id").alias("_row")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # at most one document's
    plain = bounded_filter(plain, spans.select(F.col("doc_id").alias("key")), F.col("_row"))
    clean = plain.filter("not maybe").select("doc_id", "text", F.expr("cast(null as array<struct<start:bigint,stop:bigint>>)").alias("spans"))
    marked = plain.filter("maybe").join(per_doc, "_row", "left").select("doc_id", "text", "spans")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return clean.mapInArrow(tidy(_kept), out).unionByName(marked.mapInArrow(tidy(_kept), out))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM rep),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
