"""Places and ranks over groups that may hold most of a table, without one task that sorts such a group.

A group is cut into buckets that follow its order: whatever comes before a row is then the lower buckets, of which only
sums are needed, and the rows of its own bucket, which are sorted by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import checkpointed

#: Buckets of a group about; what is gathered of a group is so many sums.
BUCKETS = 64


def bucket_of_hash(digest: Column) -> Column:
    """The first two hexadecimal digits of a hash: 256 buckets of like size, in the order of the hash."""
    return F.substring(digest, 1, 2)


def cut_points(rows: DataFrame, by: list[str], value: str, n: int = BUCKETS) -> DataFrame:
    """by and `cuts`, about n quantiles of `value` in each group."""
    shares = [i / n for i in range(1, n)]
    return rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), shares, 4 * n)).alias("cuts"))


def bucketed(rows: DataFrame, by: list[str], value: str, cuts: DataFrame) -> DataFrame:
    """`rows` with `_bucket`, the number of its group's cut points that `value` is over; null values stay out."""
    x = F.col(value).cast("double")
    out = rows.filter(x.isNotNull())
    # A row per group: how many there are is known when the join runs, and Spark broadcasts them if they are few.
    out = out.join(cuts, by) if by else out.crossJoin(F.broadcast(cuts))  # one row
    return out.withColumn("_bucket", F.size(F.filter("cuts", lambda c: c < x))).drop("cuts")


def numbered(rows: DataFrame, by: list[str], order: list, bucket: Column, name: str) -> DataFrame:
    """`rows` with `name`, their places from 1 in the order of their group. bucket: follows that order, and has a bounded
    number of values, such as `bucket_of_hash`. Ties within `order` are placed in some order."""
    marked = rows.withColumn("_b", bucket)
    inside = marked.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)))
    sums = marked.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    lists = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_b", "_n"))).alias("_l"))  # one member per bucket
    before = lambda x: F.aggregate(F.filter("_l", lambda y: y["_b"] < x["_b"]), F.lit(0).cast("long"), lambda s, y: s + y["_n"])
    offsets = lists.select(*by, F.explode(F.transform("_l", lambda x: F.struct(x["_b"].alias("_b"), before(x).alias("_before")))).alias("_o")).select(*by, "_o._b", "_o._before")
    return inside.join(offsets, [*by, "_b"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")


def upper_medians(rows: DataFrame, by: list[str], value: str, name: str = "mid") -> DataFrame:
    """by and the value at place n // 2 (from 0) of the n sorted values of each group, as a double."""
    counts = checkpointed(rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")))
    # The cuts are written down too, so that both uses of the buckets see the same ones.
    parts = bucketed(counts, by, value, checkpointed(cut_points(counts, by, value)))
    sums = parts.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_n"))
    lists = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_bucket", "_n"))).alias("_l"), F.sum("_n").alias("_t"))  # one member per bucket
    before = lambda x: F.aggregate(F.filter("_l", lambda y: y["_bucket"] < x["_bucket"]), F.lit(0).cast("long"), lambda s, y: s + y["_n"])
    place = F.floor(F.col("_t") / 2)
    home = F.filter(F.transform("_l", lambda x: F.struct(x["_bucket"].alias("_bucket"), (place - before(x)).alias("_left"), x["_n"].alias("_n"))), lambda x: (x["_left"] >= 0) & (x["_left"] < x["_n"]))
    wanted = lists.select(*by, F.get(home, F.lit(0)).alias("_h")).select(*by, "_h._bucket", "_h._left")
    own = parts.join(wanted, [*by, "_bucket"])
    upto = F.sum("_c").over(Window.partitionBy(*by, "_bucket").orderBy(value))
    hit = own.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_left"))
    return hit.groupBy(*by).agg(F.min(value).cast("double").alias(name))
