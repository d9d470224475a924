"""Joins, deduplication, splits, matching and manifest state on plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import bucket_of_hash, numbered
from tidemark.sources.shared import Scratch, checkpointed


def attach(left: DataFrame, right: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Left join of one row per key; of several the last by `order` counts. Unmatched rows keep NULLs, and `matched`
    tells them apart."""
    if order:
        columns = [c for c in right.columns if c not in (key, order)]
        right = right.groupBy(key).agg(*[F.max_by(F.struct(c), order)[c].alias(c) for c in columns])
    return left.join(right.withColumn("matched", F.lit(True)), key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def first_of(rows: DataFrame, keys: list[DataFrame], names: list[str], value: str) -> DataFrame:
    """Looks a value up under several keys in turn; the first table with an answer wins. Of several answers that a table has
    for one key the least counts, so rows stay as many as they are."""
    out = rows
    for i, (table, name) in enumerate(zip(keys, names, strict=True)):
        out = out.join(table.groupBy(F.col(table.columns[0]).alias(name)).agg(F.min(value).alias(f"_v{i}")), name, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in range(len(names))])).drop(*[f"_v{i}" for i in range(len(names))])


def override(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union of two tables, missing columns as NULL; where both have a key the second wins. Of rows that share a key in one
    table one stays. Rows are aggregated before they are shuffled, not sorted."""
    both = first.withColumn("_t", F.lit(0)).unionByName(second.withColumn("_t", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "_t")]
    kept = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.col("_t")).alias("_r"))
    return kept.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in both.columns if c != "_t"])


def near_in_time(left: DataFrame, right: DataFrame, reach_us: int) -> DataFrame:
    """Pairs of rows (ts in microseconds) at most `reach_us` apart. Times fall into bins of that width, and a row meets
    its own and the neighbouring bins, so this is an equality join and not a comparison of all pairs. A burst is a large
    partition of the join, which adaptive execution splits: each part of its left rows meets the right ones of the bin."""
    width = reach_us + 1
    a = left.withColumn("_bin", F.floor(F.col("ts") / width))
    b = right.withColumnRenamed("ts", "other_ts").withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("other_ts") / width) + d)))
    return a.join(b, "_bin").filter(F.abs(F.col("ts") - F.col("other_ts")) <= reach_us).drop("_bin")


def extended_names(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Names that extend another name of their group, with the least such name. Every proper prefix of a name is looked up
    in an equality join, so a large group is not compared with itself."""
    prefixes = rows.select(group, name, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda n: F.substring(F.col(name), F.lit(1), n))).alias("original"))
    known = rows.select(group, F.col(name).alias("original")).distinct()
    return prefixes.filter(F.col("original") != F.col(name)).join(known, [group, "original"]).groupBy(group, name).agg(F.min("original").alias("original"))


def tree_closure(edges: DataFrame, root: Column, excluded: Column) -> DataFrame:
    """Nodes (run_id, node) below the roots by (run_id, node, parent) edges; an excluded edge does not count, and a node with
    none that counts is cut off, with all that hangs on it alone. A node may have several parents, and cycles may occur.

    By pointer doubling, for all runs at once: a node is found if its pointer leads to a found node, and the pointers of the
    others skip twice as many levels each round. A tree of depth d takes log2(d) + 1 rounds; each is written to the shared
    folder. Nulls in node or parent are equal to each other."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = edges.schema["node"].dataType
    rows = edges.filter(~F.coalesce(excluded, F.lit(False))).select("run_id", text("node").alias("node"), text("parent").alias("up"), F.coalesce(root, F.lit(False)).alias("_root"))
    own = Scratch(edges.sparkSession)
    rows = own.written(rows.distinct(), "closure")
    found = rows.filter("_root").select("run_id", "node").distinct()
    left = rows.select("run_id", "node", "up").distinct().join(found, ["run_id", "node"], "left_anti")
    while True:
        new = own.written(left.join(found.withColumnRenamed("node", "up"), ["run_id", "up"]).select("run_id", "node").distinct(), "closure")
        if new.isEmpty():
            break
        found = found.unionByName(new)
        open_ = left.join(new, ["run_id", "node"], "left_anti")
        ahead = left.select("run_id", F.col("node").alias("up"), F.col("up").alias("_next"))
        left = own.written(open_.join(ahead, ["run_id", "up"]).select("run_id", "node", F.col("_next").alias("up")).distinct(), "closure")
    return own.last(found.select("run_id", F.nullif("node", F.lit("")).cast(kind).alias("node")), "closure")


def best_of(rows: DataFrame, key: Column, order: list[Column], ordinal: str) -> DataFrame:
    """One row per key: the first by `order`, then by ordinal. Rows without a key all stay. `disagreements` counts what goes."""
    blank = F.nullif(F.trim(key), F.lit(""))
    part = F.coalesce(blank, F.concat(F.lit("__"), F.col(ordinal).cast("string")))
    rank = Window.partitionBy("_key").orderBy(*order, ordinal)
    return rows.withColumn("_key", part).withColumn("_rn", F.row_number().over(rank)).filter("_rn = 1").drop("_key", "_rn")


def disagreements(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """One row: keys that occur more than once, the rows that `best_of` takes away, and the keys whose rows have different
    values (a missing one is the empty text). Rows without a key are left out."""
    part = F.nullif(F.trim(key), F.lit(""))
    per = rows.select(part.alias("_key"), F.coalesce(value, F.lit("")).alias("_v")).filter("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"))
    several = F.col("n") > 1
    return per.agg(F.count_if(several).alias("repeated"), F.coalesce(F.sum(F.when(several, F.col("n") - 1)), F.lit(0)).alias("removed"), F.count_if(several & (F.col("least") != F.col("most"))).alias("disagreed"))


def stable_order(seed: str, *keys: str) -> Column:
    """A pseudo-random order that every engine can repeat: md5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def grouped_split(rows: DataFrame, group: str, share: float, seed: str, within: list[str] | None = None) -> DataFrame:
    """`split`: train or test by whole groups, a `share` of the groups of each stratum (rounded down) to test. Groups are
    placed on their own, in buckets of their hash, and joined back."""
    within = within or []
    groups = rows.select(*within, group).distinct().withColumn("_h", stable_order(seed, group))
    ranked = numbered(groups, within, ["_h", group], bucket_of_hash(F.col("_h")), "_rn")
    sizes = groups.groupBy(*within).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(sizes, within) if within else ranked.crossJoin(sizes)  # one row
    sides = ranked.select(*within, group, F.when(F.col("_rn") <= F.floor(F.col("_n") * share), "test").otherwise("train").alias("split"))
    return rows.join(sides, [*within, group])


def deal(rows: DataFrame, stratum: str, order: list[str], parts: int, bucket: Column | None = None) -> DataFrame:
    """Round-robin: rows of each stratum are dealt to `parts` parts in turn. bucket: follows the order and has few values
    (`ranks.numbered`), for strata that are too large to be sorted by one task."""
    if bucket is None:
        turned = rows.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order)).cast("long"))
    else:
        turned = numbered(rows, [stratum], order, bucket, "turn")
    return turned.withColumn("part", ((F.col("turn") - 1) % parts).cast("long"))


def first_turns(rows: DataFrame, stratum: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each stratum, with their `turn`. Each task keeps `most` rows of a stratum at most before
    they meet, so that no stratum is sorted as a whole."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(64)))
    few = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum, "_s").orderBy(*order))).filter(F.col("_rn") <= most)
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(*order)).cast("long")
    return few.withColumn("turn", turn).filter(F.col("turn") <= most).drop("_s", "_rn")


def in_turns(rows: DataFrame, stratum: str, order: list[str], most: int) -> DataFrame:
    """`most` rows in all, the strata taking turns: all first ones, then all second ones, as far as they go."""
    return first_turns(rows, stratum, order, most).orderBy("turn", stratum).limit(most)


def match_volume(rows: DataFrame, volume: Column, y: str, key: str, seed: str = "s1") -> DataFrame:
    """In each band of volume, the larger class cut to the size of the smaller; the order of a hash of `key`, which is a row's
    own, tells which rows stay. What places them is written down once, without the other columns of the rows."""
    thin = rows.select(F.col(key).alias("_key"), volume.alias("band"), F.col(y).alias("_y"), stable_order(seed, key).alias("_h"))
    thin = checkpointed(thin.filter("_key is not null"))
    counts = thin.groupBy("band", "_y").agg(F.count(F.lit(1)).alias("c"))
    least = counts.groupBy("band").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("classes")).filter("classes = 2")
    placed = numbered(thin, ["band", "_y"], ["_h"], bucket_of_hash(F.col("_h")), "_rn")
    kept = placed.join(least.select("band", "least"), "band").filter("_rn <= least").select("_key", "band")
    return rows.join(kept, F.col(key) == F.col("_key")).drop("_key")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """The old table with rows of the new one in place of those with their key (or keys), and its other rows added. Of
    several new rows with one key one counts."""
    keys = [key] if isinstance(key, str) else key
    new = new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key the known table does not have."""
    return rows.join(known.select(key), key, "left_anti")


def write_back(manifest: DataFrame, results: DataFrame, key: str, status: str = "status", run: str = "run_id", order: str | None = None) -> DataFrame:
    """Results written into a manifest: status is replaced, a run id that is set stays. Of several results for a key the last
    by `order` counts, without it the greatest status and run."""
    result = F.struct(F.col(status).alias("_s"), F.col(run).alias("_r"))
    new = results.groupBy(key).agg((F.max_by(result, F.col(order)) if order else F.max(result)).alias("_n")).select(key, "_n.*")
    out = manifest.join(new, key, "left")
    return out.withColumns({status: F.coalesce("_s", status), run: F.coalesce(F.nullif(F.col(run), F.lit("")), F.col("_r"))}).drop("_s", "_r")


def exclude(manifest: DataFrame, held: DataFrame, key: str, note: str) -> DataFrame:
    """Pending rows that another table holds become excluded, with a note added to their notes."""
    marked = manifest.join(held.select(key).distinct().withColumn("_held", F.lit(True)), key, "left")
    hit = F.coalesce("_held", F.lit(False)) & (F.col("status") == "pending")
    trimmed = lambda c: F.btrim(c, F.lit(";"))
    own = F.concat(F.coalesce("notes", F.lit("")), F.lit(";"))
    return marked.withColumns({"notes": F.when(hit, trimmed(F.concat(own, F.lit(note)))).otherwise(trimmed(own)), "status": F.when(hit, "excluded").otherwise(F.col("status"))}).drop("_held")
