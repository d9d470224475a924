"""Evaluation of classifiers with whole families held out, on Spark ML.

Folds are few (one per family), so the loop over them runs on the driver, some at a time; fitting and scoring are distributed. Missing
values are imputed by the median of the training rows, with a column that says so, because trees here reject NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.safe import ratio
from tidemark.operators import boosting
from tidemark.operators.boosting import Boosting
from tidemark.operators.ranks import bucket_of_hash, numbered
from tidemark.operators.stats import auc, auc_of_counts, value_counts
from tidemark.operators.tables import attach, stable_order
from tidemark.sources.shared import Scratch, checkpointed

#: Columns that the verdict is made from or that follow from it, and so may not predict it.
CIRCULAR = frozenset({
    "destroyed_decoy_files", "append_renames", "distinct_rename_suffixes", "shared_extension_renames", "ransom_note_dirs",
    "ransom_note_explicit", "ransom_note_candidates", "ransom_note_name", "corroborating_axes", "destructive_events",
    "destructive_extension_variety", "destructive_chain_windows", "replacement_extension", "extension_replacements",
    "distinct_target_extensions", "verdict", "reason", "malscore",
})
#: Bookkeeping, which says nothing about behaviour.
BOOKKEEPING = frozenset({
    "sample_id", "sha256", "y", "source", "family_group", "family", "label", "coverage", "cape_family", "original_filename",
    "added_date", "notes", "source_dataset", "task_id", "_error",
})
#: The names that the operators of this library give to the same things, and splits.
OWN = frozenset({"destroyed_decoys", "self_created", "read_only_decoys", "distinct_suffixes", "shared_extension", "note_dirs", "note_name", "note_explicit", "candidates", "axes", "split", "fold", "run_id"})


def usable(columns: list[str], present: list[str]) -> list[str]:
    """The columns of a feature group that exist and do not give the label away."""
    return [c for c in columns if c in present and c not in CIRCULAR | BOOKKEEPING | OWN]


def forest(trees: int = 300) -> Callable[[], RandomForestClassifier]:
    return lambda: RandomForestClassifier(labelCol="y", featuresCol="x", weightCol="weight", numTrees=trees, seed=1)


def logistic() -> Callable[[], LogisticRegression]:
    return lambda: LogisticRegression(labelCol="y", featuresCol="x", weightCol="weight", maxIter=2000)


def fit(train: DataFrame, features: list[str], make: Callable) -> Pipeline:
    """A fitted pipeline: impute, mark what was missing, scale, classify; positives weigh max(1, negatives / positives)."""
    filled = [f"_{c}" for c in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=[*filled, *[f"_no_{c}" for c in features]], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), make()]
    counts = train.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).first()
    weight = max(1.0, counts.n / counts.p) if counts.p else 1.0
    return Pipeline(stages=stages).fit(marked(train, features).withColumn("weight", F.when(F.col("y") == 1, weight).otherwise(1.0)))


def marked(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in features}).withColumns({f"_no_{c}": F.col(c).isNull().cast("double") for c in features})


def scores(model: Pipeline, rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    return model.transform(marked(rows, features)).select(*keep, vector_to_array("probability")[1].alias("score"))


def _fold_of(n: int) -> Column:
    """The fold that a hash of a row's id deals it to."""
    return F.pmod(F.conv(F.substring(stable_order("fold", "sample_id"), 1, 8), 16, 10).cast("long"), F.lit(max(1, n)))


def _families(rows: DataFrame, family: str, least: int) -> list:
    return [r[0] for r in rows.filter("y = 1").groupBy(family).count().filter(F.col("count") >= least).orderBy(family).collect()]


def _together(jobs: list[Callable[[], DataFrame]], at_once: int) -> list[DataFrame]:
    """Fits are many small jobs, so several folds share the cluster."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda job: job(), jobs))


def leave_one_out(rows: DataFrame, features: list[str], family: str, make: Callable | Boosting, least: int = 5, hard: Column | None = None, at_once: int = 4) -> DataFrame:
    """sample_id, fold, y, part, score: each family with at least `least` positives is held out once, with a part of the
    negatives that a hash of their id deals to its fold. hard: negatives that are never trained on and are scored in every
    fold. part: positive, negative or hard. make: what makes a classifier, or how to boost, which grows all folds together."""
    families = _families(rows, family, least)
    if not families:
        return rows.limit(0).select("sample_id", "y", F.lit("").alias("part"), F.lit(0.0).alias("score"), F.lit("").alias("fold"))
    tough = F.lit(False) if hard is None else (F.col("y") == 0) & F.coalesce(hard, F.lit(False))
    marked_ = rows.withColumn("part", F.when(F.col("y") == 1, "positive").when(tough, "hard").otherwise("negative"))
    own = _fold_of(len(families))
    if isinstance(make, Boosting):
        place = F.array_position(F.array(*[F.lit(f) for f in families]), F.col(family)).cast("int") - 1
        held = F.when(F.col("part") == "hard", -2).when(F.col("part") == "positive", F.coalesce(place, F.lit(-1))).otherwise(own)
        return boosting.leave_one_out(marked_.withColumn("held", held), features, [str(f) for f in families], make)

    def one(i: int, held: object) -> DataFrame:
        test = ((F.col("part") == "positive") & F.col(family).eqNullSafe(F.lit(held))) | ((F.col("part") == "negative") & (own == i)) | (F.col("part") == "hard")
        model = fit(marked_.filter(~test), features, make)
        return scores(model, marked_.filter(test), features, ["sample_id", "y", "part"]).withColumn("fold", F.lit(str(held)))

    return reduce(DataFrame.unionByName, _together([lambda i=i, f=f: one(i, f) for i, f in enumerate(families)], at_once))


def fold_metrics(scored: DataFrame, cut: float = 0.5, ran: DataFrame | None = None) -> DataFrame:
    """Of each fold: AUC of positives against its negatives, true positive rate, and false positive rates on its negatives,
    on those of them that ran (sample_id in `ran`), and on hard ones. Rates without rows are NULL."""
    rows = scored if "part" in scored.columns else scored.withColumn("part", F.when(F.col("y") == 1, "positive").otherwise("negative"))
    rows = attach(rows, ran.select("sample_id").distinct(), "sample_id") if ran is not None else rows.withColumn("matched", F.lit(False))
    area = auc(rows.filter("part <> 'hard'").select("fold", "y", F.col("score").alias("value")), ["fold"])
    rate = lambda c: F.avg(F.when(c, (F.col("score") >= cut).cast("double")))
    part = F.col("part")
    return area.join(rows.groupBy("fold").agg(rate(part == "positive").alias("tpr"), rate(part == "negative").alias("fpr"), rate((part == "negative") & F.col("matched")).alias("fpr_ran"), rate(part == "hard").alias("fpr_hard")), "fold")


def macro(metrics: DataFrame) -> DataFrame:
    """Means over the folds; NULLs are left out."""
    return metrics.agg(*[F.avg(c).alias(c) for c in ("auc", "tpr", "fpr", "fpr_ran", "fpr_hard")])


def ablation_sets(groups: dict[str, list[str]], present: list[str], axes: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """Named sets of columns: the groups added one after another, each alone, and each axis (a list of groups). Columns that
    are not present or give the label away are left out, and so are empty sets."""
    own, so_far, sets = {g: usable(columns, present) for g, columns in groups.items()}, [], {}
    for name, columns in own.items():
        so_far = [*so_far, *[c for c in columns if c not in so_far]]
        sets[f"cumulative_{name}"], sets[f"alone_{name}"] = list(so_far), columns
    for name, members in (axes or {}).items():
        sets[f"axis_{name}"] = list(dict.fromkeys(c for g in members for c in own[g]))
    return {k: v for k, v in sets.items() if v}


def ablation(rows: DataFrame, groups: dict[str, list[str]], family: str, make: Callable, axes: dict[str, list[str]] | None = None, hard: Column | None = None) -> DataFrame:
    """Mean metrics of each of the `ablation_sets`."""
    out, done = [], {}
    for name, columns in ablation_sets(groups, rows.columns, axes).items():
        key = tuple(sorted(columns))  # sets that are equal are measured once
        if key not in done:
            done[key] = macro(fold_metrics(leave_one_out(rows, columns, family, make, hard=hard)))
        found = done[key]
        out.append(found.withColumns({"feature_set": F.lit(name), "n_features": F.lit(len(columns))}))
    return reduce(DataFrame.unionByName, out)


def leave_one_feature_out(rows: DataFrame, features: list[str], family: str, make: Callable, hard: Column | None = None) -> DataFrame:
    """Per feature: loss of mean AUC, and gain of the false positive rates, without it."""
    whole = macro(fold_metrics(leave_one_out(rows, features, family, make, hard=hard))).first()
    out = []
    for f in features:
        less = macro(fold_metrics(leave_one_out(rows, [c for c in features if c != f], family, make, hard=hard)))
        change = lambda c, base=whole: F.lit(base[c]).cast("double")
        out.append(less.select(F.lit(f).alias("feature"), (change("auc") - F.col("auc")).alias("auc_loss"), (F.col("fpr") - change("fpr")).alias("fpr_gain"), (F.col("fpr_hard") - change("fpr_hard")).alias("fpr_hard_gain")))
    return reduce(DataFrame.unionByName, out)


def permutation_importance(model: Pipeline, rows: DataFrame, features: list[str], seed: str = "p", cut: float = 0.5) -> DataFrame:
    """Per feature: loss of AUC and gain of the false positive rate where its values are those of another row. The other
    row is found once, by joining two hash orders of the rows; then all features are scored in one pass, and their scores
    are counted once for both figures.

    What comes before the classifier treats each column by itself, so it is done once for a row: a feature that is dealt is
    two numbers of the vector, its value and whether it was missing, that are the other row's."""
    n = len(features)
    ready = PipelineModel(model.stages[:-1]).transform(marked(rows, features))
    ready = checkpointed(ready.select("sample_id", "y", vector_to_array("x").alias("_x")))

    def placed(order: str) -> DataFrame:
        hashed = ready.withColumn("_h", stable_order(order, "sample_id"))
        return numbered(hashed, [], ["_h", "sample_id"], bucket_of_hash(F.col("_h")), "_rn").drop("_h")

    left = placed(f"{seed}/rows").select("_rn", "y", F.col("_x").alias("own"))
    pairs = left.join(placed(f"{seed}/others").select("_rn", F.col("_x").alias("other")), "_rn")
    counts = value_counts(_dealt_scores(model.stages[-1], pairs.select("y", "own", "other"), n), ["_f"])
    over = F.sum(F.when(F.col("value") >= cut, F.col("n")).otherwise(0.0))
    found = auc_of_counts(counts, ["_f"]).join(counts.groupBy("_f").agg(ratio(over, F.sum("n")).alias("fpr")), "_f")
    found = checkpointed(found.select("_f", "auc", "fpr"))  # a row per feature
    base = F.broadcast(found.filter("_f = -1").select(F.col("auc").alias("_auc"), F.col("fpr").alias("_fpr")))  # one row
    name = F.get(F.array(*[F.lit(c) for c in features]), F.col("_f"))
    return found.filter("_f >= 0").crossJoin(base).select(name.alias("feature"), (F.col("_auc") - F.col("auc")).alias("auc_loss"), (F.col("fpr") - F.col("_fpr")).alias("fpr_gain"))


def _dealt_scores(classifier: Transformer, pairs: DataFrame, n: int) -> DataFrame:
    """y, _f and value: the score of each vector `own` for each of n features where its numbers f and f + n are those of
    `other`, and for _f = -1 of the vector as it is. Of a forest, only trees that ask for a dealt number are walked again."""
    if isinstance(classifier, RandomForestClassificationModel):
        shared = pairs.sparkSession.sparkContext.broadcast(Forest.of(classifier))  # trees x nodes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2_048):
                    part = batch.slice(at, 2_048)
                    own, other = (pc.list_flatten(part.column(i)).to_numpy().reshape(part.num_rows, -1) for i in (1, 2))
                    for f, value in enumerate(shared.value.dealt(own, other, n), -1):
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(value), f, np.int32)), pa.array(value)], ["y", "_f", "value"])

        return pairs.withColumn("y", F.col("y").cast("int")).mapInArrow(run, "y int, _f int, value double")
    each = pairs.withColumn("_f", F.explode(F.sequence(F.lit(-1), F.lit(n - 1))))
    f, one = F.col("_f"), F.lit(1)
    dealt = F.concat(F.slice("own", one, f), F.slice("other", f + 1, one), F.slice("own", f + 2, F.lit(n - 1)), F.slice("other", f + n + 1, one), F.slice("own", f + n + 2, n - 1 - f))
    told = each.select("y", "_f", array_to_vector(F.when(f < 0, F.col("own")).otherwise(dealt)).alias("x"))
    return classifier.transform(told).select("y", "_f", vector_to_array("probability")[1].alias("value"))


@dataclass
class Forest:
    """The nodes of all trees, one after another: the number that a node asks for, its cut, its children (2 i: not over the
    cut, 2 i + 1: over it; a leaf is its own), and the shares of both classes. roots: by tree; asks: [tree, number]."""

    feature: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    shares: np.ndarray
    roots: np.ndarray
    asks: np.ndarray
    depth: int

    @classmethod
    def of(cls, model: RandomForestClassificationModel) -> Forest:
        """From the table that a fitted forest over numbers is saved as."""
        spark = SparkSession.getActiveSession()
        own = Scratch(spark)
        path = own.path("forest")
        model.save(path)
        node = F.col("nodeData")
        nodes = spark.read.parquet(f"{path}/data").select("treeID", node.id.alias("id"), node.leftChild.alias("left"), node.rightChild.alias("right"), node.split.featureIndex.alias("feature"), F.coalesce(F.get(node.split.leftCategoriesOrThreshold, F.lit(0)), F.lit(0.0)).alias("cut"), node.impurityStats.alias("stats"))
        found = nodes.orderBy("treeID", "id").toArrow()  # trees x nodes
        own.clear()
        tree, left, right, feature, cut = (found.column(c).to_numpy() for c in ("treeID", "left", "right", "feature", "cut"))
        stats = pc.list_flatten(found.column("stats")).to_numpy().reshape(len(tree), -1)[:, :2]
        roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        first, leaf, at = roots[np.cumsum(np.r_[0, tree[1:] != tree[:-1]])], left < 0, np.arange(len(tree))
        children = np.stack([np.where(leaf, at, first + left), np.where(leaf, at, first + right)], 1).ravel()
        total = stats.sum(1, keepdims=True)
        asks = np.zeros((len(roots), model.numFeatures), bool)
        asks[np.searchsorted(roots, at[~leaf], "right") - 1, feature[~leaf]] = True
        depth = max(t.depth for t in model.trees)
        return cls(np.where(leaf, 0, feature).astype(np.intp), cut, children, np.divide(stats, total, out=np.zeros_like(stats), where=total != 0), roots, asks, depth)

    def _walked(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Shares of both classes, [class, row], in the leaves of a tree."""
        node, row = np.full(len(x), self.roots[tree]), np.arange(0, x.size, x.shape[1])
        for _ in range(self.depth):
            over = ~(x.ravel().take(row + self.feature.take(node)) <= self.cut.take(node))
            node = self.children.take(2 * node + over)
        return self.shares.take(node, 0).T

    def dealt(self, own: np.ndarray, other: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Scores of the rows, then with each feature of `other` in turn. Shares are added up tree by tree, as Spark does."""
        score = lambda votes: votes[:, 1].sum(0) / votes.sum(0).sum(0)
        plain = np.stack([self._walked(own, t) for t in range(len(self.roots))])
        yield score(plain)
        for f in range(n):
            x, votes = own.copy(), plain.copy()
            x[:, [f, f + n]] = other[:, [f, f + n]]
            for t in np.flatnonzero(self.asks[:, [f, f + n]].any(1)):
                votes[t] = self._walked(x, t)
            yield score(votes)


def gain_importance(model: Pipeline, features: list[str]) -> DataFrame:
    """Per feature: its share of the gain in a fitted tree model, with that of the column that says it was missing."""
    found = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(found[i] + found[i + len(features)])) for i, f in enumerate(features)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, gain double")


def knn_scores(rows: DataFrame, features: list[str], family: str, k: int = 5, least: int = 5) -> DataFrame:
    """As `leave_one_out`, with the share of positives among the k nearest training rows as the score, after imputing
    medians and scaling by the training rows."""
    families = _families(rows, family, least)
    own, out = _fold_of(len(families)), []
    for i, held in enumerate(families):
        test = ((F.col("y") == 1) & F.col(family).eqNullSafe(F.lit(held))) | ((F.col("y") == 0) & (own == i))
        filled = [f"_{c}" for c in features]
        prepare = Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]).fit(marked(rows.filter(~test), features))
        ready = prepare.transform(marked(rows, features)).select(F.col("sample_id").alias("vec_id"), "y", vector_to_array("x").alias("vector"), test.alias("test"))
        found = nearest(ready.filter("not test").drop("test"), ready.filter("test").select("vec_id", "vector"), k)
        score = found.groupBy(F.col("asked").alias("sample_id")).agg(F.avg(F.col("y").cast("double")).alias("score"))
        out.append(ready.filter("test").select(F.col("vec_id").alias("sample_id"), "y").join(score, "sample_id").withColumn("fold", F.lit(str(held))))
    return reduce(DataFrame.unionByName, out)


def isolation_trees(x: np.ndarray, trees: int = 300, sample: int = 256, seed: int = 1) -> list[tuple[np.ndarray, ...]]:
    """Random-split trees, each of `sample` rows of x: feature, cut, left child and path length of each node (children
    follow one another; a leaf has feature -1 and the length to it with the mean of a search among its rows)."""
    rng, out = np.random.default_rng(seed), []
    deepest = int(np.ceil(np.log2(max(2, min(sample, len(x))))))
    for _ in range(trees):
        nodes, todo = [[-1, 0.0, -1, 0.0]], [(0, x[rng.permutation(len(x))[:sample]], 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = rows.min(0), rows.max(0)
            splits = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) < 2 or not len(splits):
                nodes[at] = [-1, 0.0, -1, depth + _search_length(len(rows))]
                continue
            f = int(rng.choice(splits))
            cut = float(rng.uniform(low[f], high[f]))
            nodes[at] = [f, cut, len(nodes), 0.0]
            under = rows[:, f] < cut
            todo += [(len(nodes), rows[under], depth + 1), (len(nodes) + 1, rows[~under], depth + 1)]
            nodes += [[-1, 0.0, -1, 0.0], [-1, 0.0, -1, 0.0]]
        columns = list(zip(*nodes, strict=True))
        out.append((np.array(columns[0], np.int32), np.array(columns[1]), np.array(columns[2], np.int32), np.array(columns[3])))
    return out


def _search_length(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_scores(trees: list[tuple[np.ndarray, ...]], x: np.ndarray, sample: int = 256) -> np.ndarray:
    """Anomaly of each row, 0 to 1: 2 to the power of minus its mean path length over that of a search."""
    total = np.zeros(len(x))
    for feature, cut, left, length in trees:
        at = np.zeros(len(x), np.int32)
        while (inner := feature[at] >= 0).any():
            go = np.flatnonzero(inner)
            node = at[go]
            at[go] = left[node] + (x[go, feature[node]] >= cut[node])
        total += length[at]
    return 2 ** (-total / len(trees) / max(_search_length(sample), 1e-9))


def one_class(rows: DataFrame, features: list[str], family: str, fit_on: int, trees: int = 300, sample: int = 20_000, least: int = 5) -> DataFrame:
    """An isolation forest of one class in each fold: sample_id, y, fold, score (higher: more like a positive) and cut, the
    score that 5 % of the fitted rows exceed (or 5 % fall short of, where positives are fitted).

    Imputing and scaling are fitted on all training rows, the trees on `sample` rows of the one class at most, those that a
    hash of their id puts first. Folds with under 30 such rows are left out."""
    families = _families(rows, family, least)
    own, out = _fold_of(len(families)), []
    for i, held in enumerate(families):
        test = ((F.col("y") == 1) & F.col(family).eqNullSafe(F.lit(held))) | ((F.col("y") == 0) & (own == i))
        filled = [f"_{c}" for c in features]
        prepare = Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]).fit(marked(rows.filter(~test), features))
        ready = prepare.transform(marked(rows, features)).select("sample_id", "y", vector_to_array("x").alias("x"), test.alias("test"))
        taken = ready.filter(~F.col("test") & (F.col("y") == fit_on)).orderBy(stable_order("forest", "sample_id")).limit(sample).select("x").toArrow()  # `sample` rows at most
        x = np.array(taken.column("x").to_pylist(), float)
        if len(x) < 30:
            continue
        forest, sign = isolation_trees(x, trees), 1.0 if fit_on == 0 else -1.0
        cut = float(np.percentile(sign * isolation_scores(forest, x), 95 if fit_on == 0 else 5))
        shared = rows.sparkSession.sparkContext.broadcast(forest)  # trees x 512 nodes at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared, sign=sign) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
                found = sign * isolation_scores(shared.value, points) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([batch.column("sample_id"), batch.column("y"), pa.array(found, pa.float64())], ["sample_id", "y", "score"])

        kind = dict(ready.dtypes)
        scored = ready.filter("test").drop("test").mapInArrow(run, f"sample_id {kind['sample_id']}, y {kind['y']}, score double")
        out.append(scored.withColumns({"fold": F.lit(str(held)), "cut": F.lit(cut)}))
    return reduce(DataFrame.unionByName, out)


def one_class_metrics(scored: DataFrame) -> DataFrame:
    """Of each fold of `one_class`: AUC, and rates at its cut."""
    area = auc(scored.select("fold", "y", F.col("score").alias("value")), ["fold"])
    rate = lambda y: F.avg(F.when(F.col("y") == y, (F.col("score") >= F.col("cut")).cast("double")))
    return area.join(scored.groupBy("fold").agg(rate(1).alias("tpr"), rate(0).alias("fpr")), "fold")


def agreement(scored: DataFrame, cut: float = 0.5) -> DataFrame:
    """Per sample: folds that saw it, folds that flagged it, rate and mean score."""
    flagged = (F.col("score") >= cut).cast("int")
    return scored.groupBy("sample_id").agg(F.sum(flagged).cast("long").alias("folds_flagged"), F.count(F.lit(1)).alias("n_folds"), ratio(F.sum(flagged), F.count(F.lit(1))).alias("flag_rate"), F.avg("score").alias("mean_score"))


#: Rows that a cell of `nearest` holds about, pivots at most, asked vectors of a cell that a task takes, and those of them that
#: are multiplied at once. Asked vectors are dealt once for each cell that they meet, and rows once for each part of them.
CELL, PIVOTS, ASKED, AT_ONCE = 16_000, 1_024, 40_000, 64
_FOUND = "asked long, vec_id long, y int, d double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _near(batch: pa.RecordBatch, pivots: np.ndarray, column: str) -> np.ndarray:
    """Distances of a batch's vectors to all pivots."""
    x = _matrix(batch.column(batch.schema.get_field_index(column)))
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T, 0))


def nearest(rows: DataFrame, asked: DataFrame, k: int = 5, cell: int | None = None) -> DataFrame:
    """asked, vec_id, y, d: the k nearest others of each asked vector by squared distance over all components, ties by
    vec_id. rows has vec_id, y and vector (all of one length, no NULLs), asked has vec_id and vector.

    Exact, in two rounds over cells: rows belong to the nearest of some pivots (rows that a hash of their id puts first). In
    the first round an asked vector meets the nearest cells that hold k rows together, which bounds its k-th distance. In the
    second it meets those other cells in which the triangle inequality leaves room for a nearer row, and there those rows.
    A cell's rows are dealt to tasks in blocks of `CELL`, and what a task finds is k rows for each asked vector."""
    spark, cell = rows.sparkSession, cell or CELL
    total = rows.count()
    n = int(max(1, min(PIVOTS, total // cell)))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("vector").toArrow()  # `PIVOTS` rows at most
    if not total:
        return spark.createDataFrame([], _FOUND)
    pivots = _matrix(chosen.column("vector"))
    shared, slack = spark.sparkContext.broadcast(pivots), 1e-6 * (1 + float(np.abs(pivots).max(initial=0)))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _near(batch, shared.value, "vector")
                home = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(d[np.arange(len(d)), home])], [*batch.schema.names, "cell", "reach"])

    y = rows.schema["y"].dataType.simpleString()
    held = rows.select("vec_id", "y", "vector").mapInArrow(homes, f"vec_id long, y {y}, vector array<double>, cell int, reach double")
    held = checkpointed(held)
    cells = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high")).toPandas()  # a row a pivot
    number, sizes = cells["cell"].to_numpy(), cells["n"].to_numpy()
    low, high = cells["low"].to_numpy(), cells["high"].to_numpy()
    blocks = np.ones(len(pivots), np.int64)
    blocks[number] = -(-sizes // max(1, cell))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _near(batch, shared.value, "vector")[:, number] if batch.num_rows else np.zeros((0, len(number)))
            order = np.argsort(d, 1, kind="stable")
            need = np.minimum(1 + (np.cumsum(sizes[order], 1) <= k).sum(1), len(number))  # k others: the vector itself may be a row
            yield _visits(batch, [order[i, : need[i]] for i in range(len(d))], np.full(len(d), np.inf))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _near(batch, shared.value, "vector")[:, number] if batch.num_rows else np.zeros((0, len(number)))
            bound = batch.column(batch.schema.get_field_index("bound")).to_numpy(zero_copy_only=False) + slack
            seen = batch.column(batch.schema.get_field_index("seen")).to_pylist()
            room = (d - high <= bound[:, None]) & (low - d <= bound[:, None])
            yield _visits(batch, [np.setdiff1d(np.flatnonzero(room[i]), seen[i]) for i in range(len(d))], bound)

    def _visits(batch: pa.RecordBatch, places: list[np.ndarray], bound: np.ndarray) -> pa.RecordBatch:
        many = np.array([len(p) for p in places], np.int64)
        at = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        own = np.repeat(np.arange(len(places)), many)
        base = [batch.column(batch.schema.get_field_index(c)).take(pa.array(own)) for c in ("asked", "vector")]
        return pa.RecordBatch.from_arrays([*base, pa.array(number[at], pa.int32()), pa.array(at, pa.int32()), pa.array(bound[own], pa.float64())], ["asked", "vector", "cell", "place", "bound"])

    visits = "asked long, vector array<double>, cell int, place int, bound double"
    block = F.get(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell"))
    left = held.withColumn("block", F.pmod(F.xxhash64("vec_id"), block).cast("int")).select("cell", "block", "vec_id", "y", "vector", "reach")

    def meet(asks: DataFrame) -> DataFrame:
        dealt = asks.withColumn("block", F.explode(F.sequence(F.lit(0), block - 1))).withColumn("part", F.pmod(F.xxhash64("asked"), F.lit(parts)).cast("int"))
        dealt = dealt.select(F.col("cell").alias("cell2"), F.col("block").cast("int").alias("block2"), F.col("part").alias("part2"), "asked", F.col("vector").alias("point"), "bound")
        mine = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else left.withColumn("part", F.lit(0))
        return mine.groupBy("cell", "block", "part").cogroup(dealt.groupBy("cell2", "block2", "part2")).applyInArrow(run, _FOUND)

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        columns = [c.split() for c in _FOUND.split(", ")]
        out = []
        if x.num_rows and q.num_rows:  # a side without rows has no columns either
            ids, labels, points, reach = x.column("vec_id").to_numpy(), x.column("y").to_numpy(), _matrix(x.column("vector")), x.column("reach").to_numpy()
            pivot = shared.value[x.column("cell")[0].as_py()]
            asks, bounds, wanted = q.column("asked").to_numpy(), q.column("bound").to_numpy(), _matrix(q.column("point"))
            squares = (points**2).sum(1)
            for at in range(0, len(asks), AT_ONCE):
                some = wanted[at : at + AT_ONCE]
                own_squares = (some**2).sum(1)
                rough = squares - 2 * (some @ points.T) + own_squares[:, None]
                off = np.abs(reach - np.sqrt(((some - pivot) ** 2).sum(1))[:, None]) > bounds[at : at + AT_ONCE, None] + slack
                rough[off | (ids == asks[at : at + AT_ONCE, None])] = np.inf
                last = min(k, len(ids)) - 1
                # What products round off decides nothing: rows as near as the k-th but for that are measured again.
                near_ = np.partition(rough, last, 1)[:, last] + 1e-9 * (squares.max() + own_squares)
                for i, own in enumerate(asks[at : at + AT_ONCE].tolist()):
                    fits = np.flatnonzero((rough[i] <= near_[i]) & np.isfinite(rough[i]))
                    d = ((points[fits] - some[i]) ** 2).sum(1)
                    best = np.lexsort((ids[fits], d))[:k]
                    out.append((np.full(len(best), own), ids[fits[best]], labels[fits[best]], d[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        return pa.table({name: pa.array(c.astype({"long": "i8", "int": "i4", "double": "f8"}[t]), kinds[t]) for c, (name, t) in zip(cols, columns, strict=True)})

    parts = max(1, -(-asked.count() // ASKED))
    plain = asked.select(F.col("vec_id").cast("long").alias("asked"), F.col("vector").cast("array<double>").alias("vector"))
    opened = checkpointed(plain.mapInArrow(first, visits))
    near = checkpointed(meet(opened.drop("place")))
    rank = Window.partitionBy("asked").orderBy("d", "vec_id")  # k rows from each block that was met
    kth = near.withColumn("_rn", F.row_number().over(rank)).groupBy("asked").agg(F.max(F.when(F.col("_rn") == k, F.sqrt("d"))).alias("bound"))
    seen = opened.groupBy("asked").agg(F.first("vector").alias("vector"), F.collect_list("place").alias("seen"))  # cells, of which there are PIVOTS
    bounded = seen.join(kth, "asked", "left").select("asked", "vector", "seen", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    more = meet(bounded.mapInArrow(second, visits).drop("place"))
    return near.unionByName(more).withColumn("_rn", F.row_number().over(rank)).filter(F.col("_rn") <= k).drop("_rn")
