"""Rank statistics, intervals, matched comparisons and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.safe import ratio, wilson
from tidemark.operators.ranks import bucketed, cut_points, upper_medians
from tidemark.sources.shared import checkpointed


def unpivoted(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """One row per row and feature: keys, feature, value (double); rows without a value stay out."""
    doubles = rows.select(*keys, *[F.col(f).cast("double").alias(f) for f in features])
    return doubles.unpivot(keys, features, "feature", "value").filter("value is not null")


def auc(scores: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Area under the ROC curve of `value` for `y` (0 or 1) in each group, ties counting half; NULL under `least` rows of
    either class.

    Values are counted per group first and written down, so that a hot value is one row, and groups are cut into buckets by
    value: each bucket is ranked by itself, and its positives win against all negatives of lower buckets.
    """
    return auc_of_counts(value_counts(scores, by), by, least)


def value_counts(scores: DataFrame, by: list[str]) -> DataFrame:
    """How many positives (p) and negatives (n) of each group have a value, written down."""
    return checkpointed(scores.groupBy(*by, "value").agg(F.sum("y").cast("double").alias("p"), F.sum(1 - F.col("y")).cast("double").alias("n")))


def auc_of_counts(counts: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """`auc` of such counts."""
    before = Window.partitionBy(*by, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = bucketed(counts, by, "value", cut_points(counts, by, "value")).withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    parts = below.groupBy(*by, "_bucket").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"))
    lower = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    out = parts.withColumn("wins", F.col("wins") + F.col("p") * F.coalesce(F.sum("n").over(lower), F.lit(0.0))).groupBy(*by).agg(F.sum("p").cast("long").alias("n_pos"), F.sum("n").cast("long").alias("n_neg"), F.sum("wins").alias("wins"))
    enough = (F.col("n_pos") >= least) & (F.col("n_neg") >= least)
    return out.select(*by, "n_pos", "n_neg", F.when(enough, ratio(F.col("wins"), F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def ranking(rows: DataFrame, features: list[str], y: str = "y", by: list[str] | None = None, least: int = 1) -> DataFrame:
    """AUC, coverage and upper medians by class of each feature."""
    by = by or []
    long = unpivoted(rows.withColumn("y", F.col(y)), [*by, "y"], features)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    per = long.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n"))
    mids = upper_medians(long, [*by, "feature", "y"], "value").groupBy(*by, "feature").agg(F.max(F.when(F.col("y") == 1, F.col("mid"))).alias("pos_median"), F.max(F.when(F.col("y") == 0, F.col("mid"))).alias("neg_median"))
    out = auc(long, [*by, "feature"], least).join(per, [*by, "feature"]).join(mids, [*by, "feature"])
    out = out.join(sizes, by) if by else out.crossJoin(sizes)  # one row
    return out.select(*by, "feature", "auc", ratio(F.col("n"), F.col("rows")).alias("coverage"), "pos_median", "neg_median", "n_pos", "n_neg")


def class_summary(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Least, upper median and largest value of each group, and the middle between its median and the next lower group's
    (by median), which separates the two; NULL for the lowest."""
    ends = rows.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    both = ends.join(upper_medians(rows, [group], value), group)
    lists = both.groupBy().agg(F.sort_array(F.collect_list("mid")).alias("mids"))  # one member per group
    under = F.array_max(F.filter("mids", lambda m: m < F.col("mid")))
    return both.crossJoin(lists).select(group, "low", "mid", "high", ((F.col("mid") + under) / 2).alias("separation"))  # one row


def worst_band(ranked: DataFrame) -> DataFrame:
    """Of a ranking by band: each feature's least distance of the AUC from a half, and whether all bands agree in direction."""
    known = ranked.filter("auc is not null")
    return known.groupBy("feature").agg(F.count(F.lit(1)).alias("bands"), F.min(F.abs(F.col("auc") - 0.5)).alias("worst_distance"), (F.count_distinct(F.col("auc") > 0.5) == 1).alias("consistent"))


def rates(rows: DataFrame, factor: Column, flagged: Column, least: int = 5) -> DataFrame:
    """Rate of flagged rows per level of a factor with its Wilson interval; levels under `least` rows are left out."""
    p, low, high = wilson(F.col("hits"), F.col("n"))
    per = rows.groupBy(factor.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("hits")).filter(F.col("n") >= least)
    return per.select("level", "n", "hits", p.alias("rate"), low.alias("low"), high.alias("high"))


def matched_cells(rows: DataFrame, factor: Column, a: str, b: str, covariates: list[str], flagged: Column) -> DataFrame:
    """Two levels of a factor over the cells of the covariates in which both occur: rates, intervals, and whether these
    overlap."""
    is_a, is_b = factor == a, factor == b
    cells = rows.filter(is_a | is_b).groupBy(*covariates).agg(F.count_if(is_a).alias("na"), F.count_if(is_b).alias("nb"), F.count_if(is_a & flagged).alias("ha"), F.count_if(is_b & flagged).alias("hb")).filter("na > 0 and nb > 0")
    s = cells.agg(F.count(F.lit(1)).alias("cells"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("na", "nb", "ha", "hb")])
    pa, la, ua = wilson(F.col("ha"), F.col("na"))
    pb, lb, ub = wilson(F.col("hb"), F.col("nb"))
    return s.select("cells", "na", "nb", pa.alias("rate_a"), la.alias("low_a"), ua.alias("high_a"), pb.alias("rate_b"), lb.alias("low_b"), ub.alias("high_b"), ((la <= ub) & (lb <= ua)).alias("overlap"))


def band(x: Column, cuts: list[float]) -> Column:
    """Number of the band [cut, next cut) that a value lies in, from 0 for what is under the first."""
    return sum(((x >= c).cast("int") for c in cuts), F.lit(0))


def prevalence(rows: DataFrame, features: list[str], by: str) -> DataFrame:
    """Share over 0 among the values that are there, and their number."""
    return unpivoted(rows, [by], features).groupBy(by, "feature").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") > 0).cast("double")).alias("share"))


def prevalence_gap(rows: DataFrame, features: list[str], reached: Column) -> DataFrame:
    """feature, and in percent of the values that are there: those over 0 among rows that `reached`, among the others, and the
    gap; features without values on one side are left out."""
    sides = prevalence(rows.withColumn("_side", F.coalesce(reached, F.lit(False)).cast("int")), features, "_side")
    share = lambda side: F.max(F.when(F.col("_side") == side, F.col("share"))) * 100
    both = sides.groupBy("feature").agg(share(1).alias("reached"), share(0).alias("others")).filter("reached is not null and others is not null")
    return both.withColumn("gap", F.col("reached") - F.col("others"))


def timing_summary(rows: DataFrame, features: list[str]) -> DataFrame:
    """feature, n, least, median (the mean of the two middle values of an even number) and most of the values that are there."""
    long = unpivoted(rows, [], features)
    ends = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    upper = upper_medians(long, ["feature"], "value", "upper")
    lower = upper_medians(long.withColumn("value", -F.col("value")), ["feature"], "value", "lower")
    return ends.join(upper, "feature").join(lower, "feature").select("feature", "n", "least", ((F.col("upper") - F.col("lower")) / 2).alias("median"), "most")


def precision_at(tpr: Column, fpr: Column, base_rate: float) -> Column:
    """Precision of a detector where a share `base_rate` of what it sees is positive."""
    hit, miss = tpr * base_rate, fpr * (1 - base_rate)
    return ratio(hit, hit + miss)


def cut_sweep(scores: DataFrame, cuts: list[float]) -> DataFrame:
    """True and false positive rates at each cut, in one pass."""
    y = F.col("y")
    wide = scores.agg(*[F.avg(F.when(y == k, (F.col("score") >= c).cast("double"))).alias(f"r{k}_{i}") for i, c in enumerate(cuts) for k in (0, 1)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"r1_{i}").alias("tpr"), F.col(f"r0_{i}").alias("fpr")) for i, c in enumerate(cuts)])).alias("x")).select("x.*")


def pareto(points: DataFrame, cost: str, gain: str) -> DataFrame:
    """Points of which none that costs less or as much gains as much. The points are few (one per model or group)."""
    best = F.max(gain).over(Window.orderBy(cost, F.desc(gain)).rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_best", best).filter(F.col("_best").isNull() | (F.col(gain) > F.col("_best"))).drop("_best")
