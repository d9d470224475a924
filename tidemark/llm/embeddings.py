"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

Centres are fitted on a bounded sample; every vector is assigned to the cell of its nearest centre. Two vectors at a
cosine of t or more can lie in different cells only near their common border: for unit vectors u in cell c and v in
cell d, (u.c - u.d) / |c - d| is u's distance to the border, and at most the distance of u and v's chord. So each vector
also visits the later cells whose border is that near, and no link is lost whatever the cells are. Equal vectors of one
label are collapsed first. A cell is dealt out in blocks; a task multiplies one pair of blocks, counts links per vector,
and gives a forest of them, so it never gives more rows than it has vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_filter, join_counted, settled, table, tidy, written
from tidemark.llm.components import components

COSINE = 0.93
#: Vectors that k-means is fitted on at most, vectors of the largest label that a cell holds about, and cells at most. Every
#: further cell or block is one more that vectors may have to visit, so both are large.
SAMPLE, CELL, CELLS = 20_000, 32_000, 1_024
#: Vectors in a block about, and those of them that are multiplied at once.
BLOCK, AT_ONCE = 64_000, 64


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centres of the unit vectors x: each centre is the direction of the sum of its cell. Starts from every
    len(x) / k th vector, and an empty cell keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centres)
    return centres


def _unit(rows: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), kind).astype(np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def stored(rows: DataFrame, embedding: str) -> str:
    """How a vector's bytes are kept: floats stay floats, which are exact, and half of what doubles would be."""
    return "<f4" if rows.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"


def vectors(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label, the vector as bytes (of doubles, or of floats where they are `stored` so), and a digest of it; both
    null where the vector cannot link. Doubles are scaled by a power of two, which changes no cosine, so that no square
    underflows or overflows; squares of floats do neither."""
    kind = stored(rows, embedding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is not a number here
            usable = np.logical_and.reduce([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("embedding", "label", "vec_id")])
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            starts = np.cumsum(sizes) - sizes
            labels = batch.column("label").to_pylist()
            data, digest = [None] * batch.num_rows, [None] * batch.num_rows
            for dim in np.unique(sizes[usable & (sizes > 0)]).tolist():
                own = np.flatnonzero(usable & (sizes == dim))
                x = flat[starts[own][:, None] + np.arange(dim)] + 0.0
                good = np.isfinite(x).all(1) & x.any(1)
                x, own = x[good], own[good]
                if kind == "<f8":
                    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])
                for k, v in zip(own.tolist(), x.astype(kind), strict=True):
                    data[k] = v.tobytes()
                    digest[k] = hashlib.blake2b(data[k] + repr(labels[k]).encode(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(data, pa.binary()), pa.array(digest, pa.binary())], ["vec_id", "label", "data", "digest"])

    plain = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    return plain.mapInArrow(tidy(run), "vec_id long, label string, data binary, digest binary")


def assigned(reps: DataFrame, centres: dict[int, np.ndarray], cosine: float, kind: str) -> DataFrame:
    """Each representative in its own cell (home) and in the later cells that it may have links into. Vectors of another
    length never meet: the length is part of the cell."""
    shared = reps.sparkSession.sparkContext.broadcast(centres)
    width, reach = np.dtype(kind).itemsize, np.sqrt(2 - 2 * cosine) + 1e-9  # the longest chord of a link, which no distance to a border exceeds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(d) // width for d in batch.column("data").to_pylist()])
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                c = shared.value.get(int(dim))
                home, visits = np.zeros(part.num_rows, np.int64), [(np.arange(part.num_rows), np.zeros(part.num_rows, np.int64))]
                if c is not None and len(c) > 1:
                    dot = _unit(part.column("data").to_pylist(), kind) @ c.T
                    home = dot.argmax(1)
                    gap = np.linalg.norm(c[:, None] - c[None], axis=2)
                    near = (dot[np.arange(len(home)), home][:, None] - dot) <= reach * gap[home] + 1e-9
                    near &= np.arange(len(c)) >= home[:, None]
                    near[np.arange(len(home)), home] = True
                    visits = [np.nonzero(near)]
                row, cell = visits[0]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(x).take(take) for x in ("id", "label", "data", "copies")] + [pa.array(np.full(len(row), dim), pa.int64()), pa.array(cell, pa.int64()), pa.array(cell == home[row])],
                    ["id", "label", "data", "copies", "dim", "cell", "home"],
                )

    return reps.mapInArrow(tidy(run), "id long, label string, data binary, copies long, dim long, cell long, home boolean")


def _multiply(group: pa.Table, cosine: float, kind: str) -> pa.Table:
    """Links of one task: rows (id, n, null) with a vector's number of linked vectors, rows (a, null, b) of a forest."""
    ids, side, home, copies = (group.column(c).to_numpy() for c in ("id", "side", "home", "copies"))
    order = np.lexsort((ids, ~home))  # those at home first: two visitors meet in a cell of their own
    x = _unit(group.column("data").take(pa.array(order)).to_pylist(), kind)
    ids, side, home, copies = ids[order], side[order], home[order], copies[order]
    same = not (side == 1).any()  # one block against itself, each pair once, else side 0 against side 1
    left = np.arange(int(home.sum())) if same else np.flatnonzero(side == 0)
    right = np.arange(len(ids)) if same else np.flatnonzero(side == 1)
    across = np.ascontiguousarray(x[right].T)
    n, label, forest = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
    for at in range(0, len(left), AT_ONCE):
        own, later = left[at : at + AT_ONCE], at if same else 0
        to = right[later:]
        hit = (x[own] @ across[:, later:]) >= cosine
        row, column = np.nonzero(hit)
        real = own[row] < to[column] if same else home[own[row]] | home[to[column]]
        hit[row[~real], column[~real]] = False
        row, column = row[real], column[real]
        np.add.at(n, own[row], copies[to[column]])
        np.add.at(n, to[column], copies[own[row]])
        for i in np.flatnonzero(hit.any(1)):
            linked = to[hit[i]]
            new = np.unique(label[linked])
            for lab in new[new != label[own[i]]]:
                other = linked[label[linked] == lab][0]
                forest.append((ids[own[i]], ids[other]))
                label[label == lab] = label[own[i]]
    seen = np.flatnonzero(n)
    a = np.r_[ids[seen], np.array([p[0] for p in forest], np.int64)]
    counts = pa.array([*n[seen].tolist(), *[None] * len(forest)], pa.int64())
    return pa.table({"a": pa.array(a, pa.int64()), "n": counts, "b": pa.array([*[None] * len(seen), *[int(p[1]) for p in forest]], pa.int64())})


def near_vectors(rows: DataFrame, cosine: float = COSINE, cell: int = CELL, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept.

    A vector that is null, empty, zero or holds a null or a number that is not finite, or whose label or vec_id is null,
    links with nothing: no links, its own component, kept. So do vectors of different lengths. Rows that repeat a vec_id
    count as vectors of their own in n_links, and are one node to the components. Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    spark = rows.sparkSession
    return settled(spark, lambda: _near_vectors(spark, rows.select(F.col(vec_id).alias("v"), F.col(embedding).alias("e"), F.col(label).alias("l")), cosine, cell), "near")


def _near_vectors(spark: SparkSession, rows: DataFrame, cosine: float, cell: int) -> DataFrame:
    kind = stored(rows, "e")
    width, full = np.dtype(kind).itemsize, vectors(rows, "v", "e", "l")
    all_ = written(spark, full.select("vec_id", "label", "digest"), "vectors")
    valid = all_.filter("digest is not null")
    # Only vectors that may have copies are shuffled to be collapsed.
    several = written(spark, valid.groupBy("label", "digest").count().filter("count > 1").select(F.xxhash64("label", "digest").alias("key")), "several")
    marked = bounded_filter(full.filter("digest is not null"), several, F.xxhash64("label", "digest"))
    columns = ["label", "digest", "id", "copies", "data"]
    collapsed = marked.filter("maybe").groupBy("label", "digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("data").alias("data"))
    reps = marked.filter("not maybe").select("label", "digest", F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("copies"), "data").unionByName(collapsed.select(columns))
    reps = written(spark, reps, "reps")
    dim = F.expr(f"octet_length(data) div {width}")
    sizes = reps.groupBy("label", dim.alias("dim")).count()
    known = sizes.groupBy("dim").agg(F.sum("count").alias("n"), F.max("count").alias("most")).orderBy(F.desc("n"), "dim").limit(8).collect()
    centres = {}
    for r in known:  # the commonest lengths; vectors of rarer ones have one cell, which is dealt out in blocks too
        k = min(CELLS, -(-r["most"] // cell))
        if k > 1:
            sample = reps.filter(dim == r.dim).orderBy(F.xxhash64("digest"), "id").limit(SAMPLE).select("data").toArrow()
            centres[int(r.dim)] = spherical_kmeans(_unit(sample.column("data").to_pylist(), kind), k)
    cells = assigned(reps, centres, cosine, kind).withColumn("place", F.struct("label", "dim", "cell")).drop("label", "dim", "cell")
    blocks = written(spark, cells.groupBy("place").agg(F.count(F.lit(1)).alias("_n")).withColumn("blocks", F.ceil(F.col("_n") / BLOCK).cast("int")), "blocks")
    n_cells = blocks.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    dealt = (
        join_counted(cells, blocks, "place", n_cells)
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .selectExpr("id", "data", "copies", "home", "place", "least(own, other) AS i", "greatest(own, other) AS j", "cast(own > other as int) AS side")
    )
    found = dealt.groupBy("place", "i", "j").applyInArrow(lambda group: _multiply(group, cosine, kind), "a long, n long, b long")
    found = written(spark, found, "links", 2 * n_cells)
    counts = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(spark, found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    answers = reps.join(counts, "id", "left").join(roots, "id", "left").selectExpr("digest", "copies AS _n", "coalesce(n, 0L) + copies - 1 AS n_links", "coalesce(component, id) AS component_id")
    total = reps.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    answers = written(spark, answers, "answers", total)
    linked = join_counted(valid.select("vec_id", "digest"), answers, "digest", total).select("vec_id", "n_links", "component_id")
    alone = all_.filter("digest is null").selectExpr("vec_id", "0L AS n_links", "vec_id AS component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""
