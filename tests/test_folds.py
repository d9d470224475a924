"""Every family with enough positives is a fold; importance, one-class forests and neighbours with families held out."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from tidemark.operators import ml


def test_every_family_is_held_out(spark):
    rows = [(i, int(i < 48), f"f{i % 8}" if i < 48 else "n", float(i % 7), None if i % 5 else 1.0) for i in range(100)] + [(200 + i, 1, "few", 1.0, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "sample_id long, y int, family string, a double, b double")
    scored = ml.leave_one_out(df, ["a", "b"], "family", ml.logistic()).collect()
    assert {r.fold for r in scored} == {f"f{i}" for i in range(8)}
    assert sorted(r.sample_id for r in scored) == list(range(100))
    assert {(r.sample_id, r.fold) for r in scored if r.y == 1} == {(i, f"f{i % 8}") for i in range(48)}


@pytest.fixture(scope="module")
def told(spark):
    """a tells the classes apart, b says nothing."""
    rng = np.random.default_rng(0)
    rows = [(i, int(i < 60), f"f{i % 3}" if i < 60 else "n", float(rng.normal() + 4 * (i < 60)), float(rng.normal()), None if i % 9 == 0 else 1.0) for i in range(200)]
    return spark.createDataFrame(rows, "sample_id long, y int, family string, a double, b double, c double")


def test_hard_negatives_are_scored_in_every_fold_and_never_trained_on(told):
    scored = ml.leave_one_out(told, ["a", "b"], "family", ml.logistic(), hard=F.col("sample_id") >= 190)
    rows = scored.collect()
    hard = [r for r in rows if r.part == "hard"]
    assert sorted({r.sample_id for r in hard}) == list(range(190, 200)) and len(hard) == 30
    got = ml.fold_metrics(scored, ran=told.filter("sample_id % 2 = 0")).collect()
    for r in got:
        own = [x for x in rows if x.fold == r.fold]
        rate = lambda keep: np.mean([x.score >= 0.5 for x in own if keep(x)])
        assert r.tpr == rate(lambda x: x.part == "positive") and r.fpr_hard == rate(lambda x: x.part == "hard")
        assert r.fpr == rate(lambda x: x.part == "negative") and r.fpr_ran == rate(lambda x: x.part == "negative" and x.sample_id % 2 == 0)
    assert ml.macro(ml.fold_metrics(scored)).first().fpr_ran is None


def test_ablation_sets():
    sets = ml.ablation_sets({"s": ["a", "verdict"], "v": ["b", "gone"], "e": ["gone"]}, ["a", "b", "verdict"], {"both": ["v", "s"], "none": ["e"]})
    assert sets == {"cumulative_s": ["a"], "alone_s": ["a"], "cumulative_v": ["a", "b"], "alone_v": ["b"], "cumulative_e": ["a", "b"], "axis_both": ["b", "a"]}


def test_importance(told):
    model = ml.fit(told, ["a", "b", "c"], ml.forest(10))
    loss = {r.feature: (r.auc_loss, r.fpr_gain) for r in ml.permutation_importance(model, told, ["a", "b", "c"]).collect()}
    assert loss["a"][0] > 0.2 > abs(loss["b"][0]) and loss["a"][1] > loss["b"][1]
    gain = {r.feature: r.gain for r in ml.gain_importance(model, ["a", "b", "c"]).collect()}
    assert gain["a"] > 0.8 and abs(sum(gain.values()) - 1) < 1e-6
    without = {r.feature: r.auc_loss for r in ml.leave_one_feature_out(told, ["a", "b"], "family", ml.logistic()).collect()}
    assert without["a"] > 0.2 > abs(without["b"])


class Counted(Transformer):
    """A classifier that counts the rows that it scores."""

    def __init__(self, inner, seen):
        super().__init__()
        self.inner, self.seen = inner, seen

    def _transform(self, df):
        seen = self.seen
        return self.inner.transform(df.withColumn("x", F.udf(lambda x: seen.add(1) or x, VectorUDT())("x")))


def test_importance_scores_each_dealt_row_once(told, spark):
    names = ["a", "b", "c"]
    model, seen = ml.fit(told, names, ml.forest(10)), spark.sparkContext.accumulator(0)
    counted = PipelineModel([*model.stages[:-1], Counted(model.stages[-1], seen)])
    rows = sorted(ml.permutation_importance(counted, told, names).collect())
    assert seen.value == 4 * 200  # three features, and as they are
    assert rows == sorted(ml.permutation_importance(model, told, names).collect())  # walks only trees that ask for a feature


def test_forest_scores_as_spark_does(told):
    names = ["a", "b", "c"]
    model = ml.fit(told, names, ml.forest(10))
    rows = PipelineModel(model.stages[:-1]).transform(ml.marked(told, names))
    x = np.array([r.x.toArray() for r in rows.orderBy("sample_id").collect()])
    plain, *dealt = ml.Forest.of(model.stages[-1]).dealt(x, x[::-1], 3)
    score = lambda v: [model.stages[-1].predictProbability(Vectors.dense(r))[1] for r in v]
    assert plain.tolist() == score(x)
    for f, got in enumerate(dealt):
        other = x.copy()
        other[:, [f, f + 3]] = x[::-1][:, [f, f + 3]]
        assert got.tolist() == score(other)


def test_isolation_forest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    trees = ml.isolation_trees(x, 50)
    scores = ml.isolation_scores(trees, np.r_[x, [[9.0, 9.0, 9.0]]])
    assert scores[-1] == scores.max() and 0 < scores.min() and scores.max() < 1
    assert ml.isolation_scores(ml.isolation_trees(np.ones((40, 2)), 5), np.ones((2, 2))).tolist() == ml.isolation_scores(ml.isolation_trees(np.ones((40, 2)), 5), np.zeros((2, 2))).tolist()


def test_one_class_and_neighbours(told):
    for y in (0, 1):
        scored = ml.one_class(told, ["a", "b"], "family", y, trees=40)
        areas = [r.auc for r in ml.one_class_metrics(scored).collect()]
        assert len(areas) == 3 and min(areas) > 0.8
    scored = ml.knn_scores(told, ["a", "b", "c"], "family")
    assert scored.count() == 200 and min(r.auc for r in ml.fold_metrics(scored).collect()) > 0.9
