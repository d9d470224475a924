"""Queries that fit models: rows only (no SQL can give their scores)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ml
from tidemark.operators.boosting import Boosting
from tidemark.plans.registry import query
from tidemark.sources.testdata import table

#: Components of a vector.
ALL = [f"e{i}" for i in range(64)]


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as samples: labels under 5 are positive, the label is the family."""
    rows = table(spark, sf, "embeddings").filter("label is not null and embedding is not null")
    return rows.select(F.col("vec_id").alias("sample_id"), (F.col("label") < 5).cast("int").alias("y"), F.col("label").cast("string").alias("family"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(ALL)])


@query("e12_leave_one_family_out")
def leave_one_family_out(spark: SparkSession, sf: str) -> DataFrame:
    """Every family held out, 300 trees; every tenth negative is a hard one, which is never trained on."""
    rows = _samples(spark, sf)
    ran = rows.filter("sample_id % 3 = 0")
    return ml.fold_metrics(ml.leave_one_out(rows, ALL, "family", Boosting(), hard=F.col("sample_id") % 10 == 0), ran=ran)


@query("e13_ablation")
def ablation(spark: SparkSession, sf: str) -> DataFrame:
    groups = {"a": [*ALL[:32], "verdict"], "b": [*ALL[32:], "missing"]}
    return ml.ablation(_samples(spark, sf), groups, "family", ml.logistic(), axes={"second": ["b"]})


@query("e14_permutation_importance")
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = _samples(spark, sf)
    model = ml.fit(rows, ALL, ml.forest())
    return ml.permutation_importance(model, rows, ALL).join(ml.gain_importance(model, ALL), "feature")


@query("e15_leave_one_feature_out")
def leave_one_feature_out(spark: SparkSession, sf: str) -> DataFrame:
    """Four features, each the sum of sixteen components."""
    rows = _samples(spark, sf)
    summed = rows.select("sample_id", "y", "family", *[sum((F.col(c) for c in ALL[i : i + 16]), F.lit(0.0)).alias(f"s{i // 16}") for i in range(0, 64, 16)])
    return ml.leave_one_feature_out(summed, [f"s{i}" for i in range(4)], "family", ml.logistic())


@query("e16_other_classifiers")
def other_classifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Forest, logistic regression and nearest neighbours, families held out."""
    rows = _samples(spark, sf)
    found = {"forest": ml.leave_one_out(rows, ALL, "family", ml.forest()), "logistic": ml.leave_one_out(rows, ALL, "family", ml.logistic()), "neighbours": ml.knn_scores(rows, ALL, "family")}
    parts = [ml.agreement(scored.select("sample_id", "score")).withColumn("model", F.lit(name)) for name, scored in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("e17_one_class")
def one_class(spark: SparkSession, sf: str) -> DataFrame:
    """Isolation forests of either class."""
    rows = _samples(spark, sf)
    parts = [ml.one_class_metrics(ml.one_class(rows, ALL, "family", y)).withColumn("fit_on", F.lit(y)) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


@query(
    "e16_nearest_neighbours",
    """WITH s AS (SELECT vec_id, CAST(label < 5 AS INT) AS y, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
d AS (SELECT q.vec_id, r.y, r.vec_id AS other, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - r.e[i]) * (q.e[i] - r.e[i]))) AS d FROM s q JOIN s r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT vec_id, y, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) AS rn FROM d)
SELECT vec_id, CAST(sum(y) AS BIGINT) AS positive_neighbours FROM p WHERE rn <= 5 GROUP BY vec_id""",
)
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth vector against all, over all components, in blocks."""
    rows = table(spark, sf, "embeddings").filter("label is not null and embedding is not null")
    rows = rows.select("vec_id", (F.col("label") < 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("vector"))
    found = ml.nearest(rows, rows.filter("vec_id % 100 = 0").select("vec_id", "vector"))
    return found.groupBy(F.col("asked").alias("vec_id")).agg(F.sum("y").cast("long").alias("positive_neighbours"))
