"""Gradient boosting on histograms, for all folds of an evaluation together.

Values are put into bins once. Every row knows the fold that holds it out, and every fold has a tree of its own in each
round. A level of all folds' trees is one job: tasks sum gradients by (fold, node, feature, bin) over the rows that they
read, the sums meet by (fold, node, feature), where the best cut is found, and only cuts reach the driver. So the number of
jobs is trees times depth, whatever the folds and the data. Rows carry their margins in each fold, to which each round adds its
trees; they are kept by the executors, and written to the shared folder every `KEEP` rounds, so a lost executor costs these.

Up to `SMALL` rows a job would take longer to start than to run: then each fold is a task that grows all of its trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import Scratch

#: Rounds between two writings of the margins.
KEEP = 25
#: Rows up to which a fold is one task.
SMALL = 20_000
#: Folds whose trees grow together; a task's sums are folds x nodes x features x bins pairs of numbers.
FOLDS = 16


@dataclass(frozen=True)
class Boosting:
    """share: of the rows that a tree of a fold sees. l2, least: on leaf weights, and the least weight of a leaf."""

    trees: int = 300
    depth: int = 5
    rate: float = 0.08
    share: float = 0.9
    bins: int = 32
    l2: float = 1.0
    least: float = 1.0


@dataclass
class Trees:
    """A round's trees, [fold, node]: the children of node i are 2 i + 1 and 2 i + 2; a leaf has feature -1. A value goes
    right where its bin is over the cut, a missing one where `missing` says."""

    feature: np.ndarray
    cut: np.ndarray
    missing: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, folds: int, depth: int) -> Trees:
        size = (folds, 2 ** (depth + 1) - 1)
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, bool), np.zeros(size))

    def leaves(self, x: np.ndarray, fold: int) -> np.ndarray:
        """The node that each row of bins ends in."""
        node = np.zeros(len(x), np.int64)
        while len(go := np.flatnonzero(self.feature[fold, node] >= 0)):
            at = node[go]
            bins = x[go, self.feature[fold, at]]
            right = np.where(bins == 0, self.missing[fold, at], bins > self.cut[fold, at])
            node[go] = 2 * at + 1 + right
        return node

    def add_to(self, margins: np.ndarray, x: np.ndarray) -> None:
        for k in range(len(self.feature)):
            margins[:, k] += self.value[k, self.leaves(x, k)]


def edges_of(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Cut points of each feature: its quantiles over all rows, distinct ones."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), shares).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(q or [], float)) for q in found]


def binned(rows: DataFrame, features: list[str], edges: list[np.ndarray], keep: list[str]) -> DataFrame:
    """`keep` and x, a byte for each feature: 0 for a missing value, else 1 and the cut points that lie under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, len(edges)), np.uint8)
            for i, e in enumerate(edges):
                v = batch.column(len(keep) + i).to_numpy(zero_copy_only=False)
                known = ~np.isnan(v)
                x[known, i] = 1 + np.searchsorted(e, v[known], "left")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([r.tobytes() for r in x], pa.binary())], [*keep, "x"])

    plain = rows.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_{i}") for i, c in enumerate(features)])
    ddl = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes[: len(keep)])
    return plain.mapInArrow(run, f"{ddl}, x binary")


def in_sample(ids: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether a tree sees a row, by a hash of the row's number and the tree's."""
    x = ids.astype(np.uint64) ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(float) / 2.0**53 < share


def best_cuts(sums: np.ndarray, how: Boosting) -> tuple[np.ndarray, ...]:
    """Of (gradient, weight) by feature and bin: each one's best gain, cut, whether missing values go right, and left sums."""
    n, (g, h) = len(sums), sums.sum(1).T[:, :, None]
    score = lambda a, b: a * a / (b + how.l2)
    under = np.cumsum(sums[:, 1:], 1)[:, :-1]
    gain, cut, right, left = np.zeros(n), np.full(n, -1), np.zeros(n, bool), np.zeros((n, 2))
    for missing in (False, True):
        lg, lh = (under if missing else under + sums[:, :1]).transpose(2, 0, 1)
        fits = (lh >= how.least) & (h - lh >= how.least)
        found = np.where(fits, score(lg, lh) + score(g - lg, h - lh) - score(g, h), 0.0)
        i = found.argmax(1)
        better = np.flatnonzero(found[np.arange(n), i] > gain + 1e-12)
        at = i[better]
        gain[better], cut[better], right[better] = found[better, at], at + 1, missing
        left[better] = np.stack([lg[better, at], lh[better, at]], 1)
    return gain, cut, right, left


STATE = "number long, y int, held int, x binary, margins array<double>"
CUTS = "fold int, node int, feature int, gain double, cut int, missing boolean, lg double, lh double, g double, h double"


class _Rows:
    """A batch of the state."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, folds: int):
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        self.number, self.y, self.held = (column(c).to_numpy() for c in ("number", "y", "held"))
        self.x = np.frombuffer(b"".join(column("x").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        self.margins = pc.list_flatten(column("margins")).to_numpy().reshape(-1, folds).copy()


def _sums(x: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, bins: int) -> np.ndarray:
    """Gradients and weights of rows by (node, feature), bin."""
    out, base = np.empty((nodes, x.shape[1], bins, 2)), node * bins
    for f, values in enumerate(np.ascontiguousarray(x.T)):
        place = base + values
        for i, weights in enumerate((g, h)):
            out[:, f, :, i] = np.bincount(place, weights, nodes * bins).reshape(nodes, bins)
    return out.reshape(-1, bins, 2)


def _gradients(y: np.ndarray, margins: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    p, w = 1 / (1 + np.exp(-margins)), np.where(y == 1, weight, 1.0)
    return w * (p - y), w * p * (1 - p)


def _found(keys: np.ndarray, sums: np.ndarray, nodes: int, n_features: int, how: Boosting) -> pa.RecordBatch:
    """The best feature of each node, of those whose sums are here."""
    gain, cut, missing, left = best_cuts(sums, how)
    node, feature = np.divmod(keys, n_features)
    order = np.lexsort((feature, -gain, node))
    i = order[np.r_[True, node[order][1:] != node[order][:-1]][: len(order)]]
    whole = sums[i].sum(1)
    columns = [node[i] // nodes, node[i] % nodes, feature[i], gain[i], cut[i], missing[i], left[i, 0], left[i, 1], whole[:, 0], whole[:, 1]]
    kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.bool_()] + [pa.float64()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in CUTS.split(", ")])


def _level(state: DataFrame, now: Trees, tree: int, level: int, weights: list[float], n_features: int, how: Boosting) -> list[dict]:
    """The best cuts of each node of a level, over all folds."""
    folds, nodes, bins = len(weights), 2**level, how.bins + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, nodes * n_features, bins, 2))
        for batch in batches:
            rows = _Rows(batch, folds)
            seen = in_sample(rows.number, tree, how.share) & (rows.held > -2)
            for k in range(folds):
                own = np.flatnonzero(seen & (rows.held != k))
                node = now.leaves(rows.x[own], k) - (nodes - 1)
                at, node = own[node >= 0], node[node >= 0]  # rows in leaves above do not count
                total[k] += _sums(rows.x[at], node, *_gradients(rows.y[at], rows.margins[at, k], weights[k]), nodes, bins)
        each = total.reshape(-1, bins, 2)
        some = np.flatnonzero(each.any((1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([each[i].tobytes() for i in some], pa.binary())], ["key", "sums"])

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds * nodes * n_features, bins, 2))
        for batch in batches:
            np.add.at(total, batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, bins, 2))
        some = np.flatnonzero(total.any((1, 2)))
        yield _found(some, total[some], nodes, n_features, how)

    met = state.mapInArrow(sums, "key long, sums binary")
    parts = max(1, min(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), folds * nodes * n_features // 2_000))
    return met.repartition(parts, "key").mapInArrow(cuts, CUTS).toArrow().to_pylist()  # folds x nodes rows a partition at most


def _planted(now: Trees, level: int, found: list[dict], how: Boosting) -> bool:
    """Puts the best cuts of a level into the trees; whether there were any."""
    leaf = lambda g, h: -how.rate * g / (h + how.l2)
    best: dict[tuple[int, int], dict] = {}
    for r in found:
        key = (r["fold"], r["node"])
        if key not in best or (r["gain"], -r["feature"]) > (best[key]["gain"], -best[key]["feature"]):
            best[key] = r
    for (k, node), r in best.items():
        at = node + 2**level - 1
        now.value[k, at] = leaf(r["g"], r["h"])
        if r["gain"] > 1e-9:
            now.feature[k, at], now.cut[k, at], now.missing[k, at] = r["feature"], r["cut"], r["missing"]
            now.value[k, 2 * at + 1], now.value[k, 2 * at + 2] = leaf(r["lg"], r["lh"]), leaf(r["g"] - r["lg"], r["h"] - r["lh"])
    return any(r["gain"] > 1e-9 for r in best.values())


def _grow(state: DataFrame, tree: int, weights: list[float], n_features: int, how: Boosting) -> Trees:
    now = Trees.empty(len(weights), how.depth)
    for level in range(how.depth):
        if not _planted(now, level, _level(state, now, tree, level, weights, n_features, how), how):
            break
    return now


def _grow_small(state: DataFrame, weights: list[float], n_features: int, how: Boosting) -> list[Trees]:
    """All trees over `SMALL` rows at most: a task for each fold."""
    folds, bins = len(weights), how.bins + 1
    fields = ("feature", "cut", "missing", "value")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        k = key[0].as_py()
        rows = _Rows(group.sort_by("number"), folds)
        margins, out = np.zeros((len(rows.y), 1)), []
        for t in range(how.trees):
            now = Trees.empty(1, how.depth)
            own = np.flatnonzero(in_sample(rows.number, t, how.share) & (rows.held > -2) & (rows.held != k))
            x, (g, h) = rows.x[own], _gradients(rows.y[own], margins[own, 0], weights[k])
            for level in range(how.depth):
                nodes = 2**level
                node = now.leaves(x, 0) - (nodes - 1)
                at = np.flatnonzero(node >= 0)
                sums = _sums(x[at], node[at], g[at], h[at], nodes, bins)
                some = np.flatnonzero(sums.any((1, 2)))
                if not _planted(now, level, _found(some, sums[some], nodes, n_features, how).to_pylist(), how):
                    break
            now.add_to(margins, rows.x)
            out.append({"fold": k, "tree": t} | {f: getattr(now, f)[0].tobytes() for f in fields})
        return pa.Table.from_pylist(out, pa.schema([("fold", pa.int32()), ("tree", pa.int32()), *[(f, pa.binary()) for f in fields]]))

    each = state.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).repartition(2 * folds, "fold")
    grown = each.groupBy("fold").applyInArrow(run, "fold int, tree int, " + ", ".join(f"{f} binary" for f in fields)).toArrow().to_pylist()  # folds x trees rows
    trees = [Trees.empty(folds, how.depth) for _ in range(how.trees)]
    for r in grown:
        for f in fields:
            own = getattr(trees[r["tree"]], f)
            own[r["fold"]] = np.frombuffer(r[f], own.dtype)
    return trees


def boost(rows: DataFrame, n_features: int, folds: int, how: Boosting) -> tuple[DataFrame, list[Trees], Scratch]:
    """number and margins (one of each fold) of every row, the trees, and the tables to clear when the margins are read.

    rows: number (of the row; ids of any kind through a hash), y (0 or 1), held (the fold that does not train on it, -1: all
    train, -2: none), x. In each fold positives weigh max(1, negatives / positives) of its training rows."""
    own = Scratch(rows.sparkSession)
    counts = {(r.held, r.y): r["count"] for r in rows.filter("held > -2").groupBy("held", "y").count().collect()}  # folds x 2
    weights = []
    for k in range(folds):
        negatives, positives = (sum(n for (held, label), n in counts.items() if label == y and held != k) for y in (0, 1))
        weights.append(max(1.0, negatives / positives) if positives else 1.0)
    state = own.written(rows.selectExpr("number", "y", "held", "x", f"array_repeat(0.0D, {folds}) AS margins"), "boosting")
    if rows.count() <= SMALL:
        trees = _grow_small(state, weights, n_features, how)
        return own.replaced(_settled(state, trees, folds), "boosting").select("number", "margins"), trees, own
    trees, kept = [], []
    for t in range(how.trees):
        trees.append(_grow(state, t, weights, n_features, how))
        while len(kept) > 1:  # this round has read the last one, which was made of those before it
            kept.pop(0).unpersist()
        state = _settled(state, trees[-1:], folds)
        if (t + 1) % KEEP and t < how.trees - 1:
            kept.append(state.persist())
        else:
            state = own.replaced(state, "boosting")
            while kept:
                kept.pop().unpersist()
    return state.select("number", "margins"), trees, own


def _settled(state: DataFrame, done: list[Trees], folds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(batch, folds)
            for trees in done:
                trees.add_to(rows.margins, rows.x)
            margins = rows.margins
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, margins.size + 1, folds), pa.int32()), pa.array(margins.ravel()))
            yield batch.set_column(batch.schema.get_field_index("margins"), "margins", lists)

    return state.mapInArrow(run, STATE)


def leave_one_out(rows: DataFrame, features: list[str], folds: list[str], how: Boosting) -> DataFrame:
    """sample_id, y, part, fold, score of every row that a fold holds out. rows: sample_id, y, part, held (a place in `folds`,
    -1: no fold holds it out, -2: all do and none trains on it), and the features."""
    spark = rows.sparkSession
    keep = ["sample_id", "y", "part", "held"]
    own = Scratch(spark)
    table = binned(rows.withColumns({"y": F.col("y").cast("int"), "held": F.col("held").cast("int")}), features, edges_of(rows, features, how.bins), keep)
    table = own.written(table.withColumn("number", F.xxhash64("sample_id")), "binned")
    out = None
    for at in range(0, len(folds), FOLDS):
        group = folds[at : at + FOLDS]
        mine = F.when((F.col("held") >= at) & (F.col("held") < at + len(group)), F.col("held") - at).when(F.col("held") == -2, -2).otherwise(-1)
        margins, _, more = boost(table.select("number", "y", mine.alias("held"), "x"), len(features), len(group), how)
        tested = table.filter((F.col("held") == -2) | F.col("held").between(at, at + len(group) - 1))
        fold = F.explode(F.when(F.col("held") == -2, F.sequence(F.lit(0), F.lit(len(group) - 1))).otherwise(F.array(F.col("held") - at)))
        scored = tested.select("sample_id", "y", "part", "number", fold.alias("k")).join(margins.dropDuplicates(["number"]), "number")
        names = F.array(*[F.lit(f) for f in group])
        part = own.written(scored.select("sample_id", "y", "part", F.get(names, F.col("k")).alias("fold"), (1 / (1 + F.exp(-F.get("margins", F.col("k"))))).alias("score")), "scored")
        more.clear()
        out = part if out is None else out.unionByName(part)
    return own.last(out, "scores")
