"""First evidence, onsets, behaviour sequences, and mining of subsequences that tell two classes apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.safe import ratio


def stage_features(log: DataFrame, rules: dict[str, Column], unclean: list[str]) -> DataFrame:
    """Presence and earliest time of named stages; numbers of all and of those outside `unclean`; seconds between the
    first and the last, of two timed stages or more."""
    marks = log.select("run_id", "ts", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(s)) for s, c in rules.items()]))).alias("stage"))
    first = marks.groupBy("run_id", "stage").agg(F.min("ts").alias("ts"))
    return first.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_stages"),
        F.count_if(~F.col("stage").isin(unclean)).alias("n_stages_clean"),
        *[F.bool_or(F.col("stage") == s).cast("int").alias(f"stage_{s}") for s in rules],
        F.count("ts").alias("n_timed"),
        F.when(F.count("ts") >= 2, (F.max("ts") - F.min("ts")) / 1e6).alias("stage_span_s"),
    )


def preparation(log: DataFrame, prepares: Column) -> DataFrame:
    """Preparing events against the window of destruction. The first delay counts from the first write, move or delete,
    the others from deletes alone. Overlap also holds where preparing merely comes first. Without preparing events or
    deletes, what depends on both is NULL."""
    kind, ts = F.col("kind"), F.col("ts")
    by = Window.partitionBy("run_id")
    seen = log.select(
        "run_id",
        F.when(prepares, ts).alias("p"),
        F.min(F.when(kind.isin("write", "delete", "move"), ts)).over(by).alias("touch"),
        F.min(F.when(kind == "delete", ts)).over(by).alias("d0"),
        F.max(F.when(kind == "delete", ts)).over(by).alias("d1"),
    )
    per = seen.groupBy("run_id").agg(
        F.count("p").alias("n_prep"), F.min("p").alias("p0"), F.first("touch").alias("touch"), F.first("d0").alias("d0"), F.first("d1").alias("d1"), F.count_if(F.col("p") < F.col("d0")).alias("b"), F.count_if(F.col("p").between(F.col("d0"), F.col("d1"))).alias("u"), F.count_if(F.col("p") > F.col("d1")).alias("a")
    )
    both = F.col("d0").isNotNull() & (F.col("n_prep") > 0)
    return per.select(
        "run_id",
        "n_prep",
        ((F.col("touch") - F.col("p0")) / 1e6).alias("prep_to_touch_s"),
        ((F.col("d0") - F.col("p0")) / 1e6).alias("prep_to_destroy_s"),
        F.when(both, F.col("b")).alias("prep_before"),
        F.when(both, F.col("u")).alias("prep_during"),
        F.when(both, F.col("a")).alias("prep_after"),
        F.when(both, (F.col("p0") <= F.col("d1")).cast("int")).alias("prep_overlaps_destroy"),
        ratio(F.col("p0") - F.col("d0"), F.col("d1") - F.col("d0")).alias("prep_position"),
    )


def sequences(marks: DataFrame) -> DataFrame:
    """run_id and its tokens in the order of first evidence (time, then place); each token once."""
    first = marks.filter("token is not null").groupBy("run_id", "token").agg(F.min("pos").alias("pos"), F.min_by("ts", "pos").alias("ts"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "pos", "token")))
    return first.groupBy("run_id").agg(F.transform(ordered, lambda x: x["token"]).alias("sequence"))


def seen_before(log: DataFrame, key: Column, marks: Column) -> DataFrame:
    """`seen`: whether an earlier event of the run with this key is marked."""
    by = Window.partitionBy("run_id", "_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("_key", key).withColumn("seen", F.coalesce(F.bool_or(marks).over(by), F.lit(False))).drop("_key")


def rewrite_onset(log: DataFrame, keys: list[Column], least: int = 20) -> DataFrame:
    """Time and place of the first write to something that was read before, by any of the keys (such as path and stem), of
    runs with at least `least` such writes."""
    each = log.withColumn("_each", F.explode(F.array_distinct(F.array(*keys))))
    hits = seen_before(each, F.col("_each"), F.col("kind") == "read").filter("kind = 'write' and seen").select("run_id", "pos", "ts").distinct()
    return hits.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rewrites"), F.min_by("ts", "pos").alias("onset"), F.min("pos").alias("pos")).filter(F.col("n_rewrites") >= least)


def spread_onset(log: DataFrame, name: Column, place: Column, least: int = 5) -> DataFrame:
    """First event of a name that occurs in at least `least` places; widest spread and number of such names."""
    per = log.groupBy("run_id", name.alias("_name")).agg(F.count_distinct(place).alias("dirs"), F.min_by("ts", "pos").alias("onset")).filter(F.col("dirs") >= least)
    return per.groupBy("run_id").agg(F.max("dirs").alias("widest"), F.count(F.lit(1)).alias("names"), F.min("onset").alias("onset"))


def presence_and_order(found: DataFrame, tokens: list[str]) -> DataFrame:
    """has_T per token, and ord_A_B per pair: 1 where A comes first, 0 where B does, NULL unless both occur."""
    at = lambda t: F.nullif(F.array_position("sequence", t), F.lit(0))
    pairs = [(a, b) for i, a in enumerate(tokens) for b in tokens[i + 1 :]]
    return found.select("run_id", *[F.array_contains("sequence", t).cast("int").alias(f"has_{t}") for t in tokens], *[(at(a) < at(b)).cast("int").alias(f"ord_{a}_{b}") for a, b in pairs])


def islands(log: DataFrame, value: Column) -> DataFrame:
    """Maximal runs of events with one value: number, value, first place and length."""
    by = Window.partitionBy("run_id").orderBy("pos")
    v = log.withColumn("value", value)
    changed = F.coalesce(F.lag("value").over(by) != F.col("value"), F.lit(True)).cast("long")
    numbered = v.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("run_id", "island").agg(F.min("value").alias("value"), F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("length"))


def holds(sequence: Column, pattern: Column) -> Column:
    """Whether the tokens of the pattern occur in the sequence in their order, with gaps; tokens are unique in it."""
    places = F.transform(pattern, lambda t: F.array_position(sequence, t))
    ok = F.aggregate(places, F.lit(0).cast("long"), lambda last, p: F.when((last >= 0) & (p > last), p).otherwise(F.lit(-1).cast("long")))
    return ok > 0


def _tried(found: DataFrame, patterns: list[list[str]]) -> DataFrame:
    """run_id, n: the numbers of the patterns that each sequence holds, in one pass and without a join."""
    each = F.array_compact(F.array(*[F.when(holds(F.col("sequence"), F.array(*[F.lit(t) for t in p])), F.lit(i)) for i, p in enumerate(patterns)]))
    return found.select("run_id", F.explode(each).alias("n"))


def frequent_patterns(found: DataFrame, support: float, longest: int = 5, least: int = 2, most: int = 20_000) -> DataFrame:
    """Subsequences with gaps that occur in at least max(`least`, support x runs) sequences, counted once for each.

    Level by level: candidates of k tokens are made from the frequent ones of k - 1 whose ends overlap, and each level is one
    pass over the sequences that tries its candidates and adds up hits; no embedding of a pattern is ever a row. The
    vocabulary of tokens is fixed by rules, so candidates are few; over `most` of a level is an error, not a cut.
    `support_count` is the number of sequences."""
    spark, found = found.sparkSession, found.select("run_id", "sequence").persist()  # read once a level
    total = found.count()
    need = max(least, int(support * total))
    singles = found.select("run_id", F.explode(F.array_distinct("sequence")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    kept = sorted(((r.token,), r.n) for r in singles.filter(F.col("n") >= need).collect())  # tokens of a fixed vocabulary
    out = list(kept)
    level = [p for p, _ in kept]
    for _ in range(longest - 1):
        grown = [a + b[-1:] for a in level for b in level if a[1:] == b[:-1] and b[-1] not in a]
        if len(grown) > most:
            raise ValueError(f"{len(grown)} candidates of {len(level[0]) + 1} tokens: raise the support or `most`")
        if not grown:
            break
        hits = []
        for at in range(0, len(grown), 500):  # candidates of one expression
            part = grown[at : at + 500]
            counts = _tried(found, [list(p) for p in part]).groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= need)
            hits += [(part[r.n], r.c) for r in counts.collect()]  # a row per candidate at most
        out += sorted(hits)
        level = [p for p, _ in sorted(hits)]
    found.unpersist()
    rows = spark.createDataFrame([(list(p), n) for p, n in out], "pattern array<string>, support_count long")
    return rows.withColumn("support", ratio(F.col("support_count"), F.lit(total)))


def contrast(patterns: DataFrame, positive: DataFrame, negative: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Support of each pattern in both classes and the difference; those at or over the threshold. The patterns are few
    (each is frequent), and are tried on every sequence in one pass."""
    spark = patterns.sparkSession
    listed = [r[0] for r in patterns.select("pattern").collect()]
    positive, negative = (rows.select("run_id", "sequence").persist() for rows in (positive, negative))
    n_pos, n_neg = positive.count(), negative.count()
    hits: dict[tuple, list[int]] = {tuple(p): [0, 0] for p in listed}
    for y, rows in ((0, negative), (1, positive)):
        for at in range(0, len(listed), 500):
            for r in _tried(rows, listed[at : at + 500]).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect():
                hits[tuple(listed[at + r.n])][y] = r.c
        rows.unpersist()
    both = spark.createDataFrame([(list(p), c[1], c[0]) for p, c in hits.items()], "pattern array<string>, pos_hits long, neg_hits long")
    pos, neg = ratio(F.col("pos_hits"), F.lit(n_pos)), ratio(F.col("neg_hits"), F.lit(n_neg))
    return both.select("pattern", F.size("pattern").cast("long").alias("length"), pos.alias("pos_support"), neg.alias("neg_support"), (pos - neg).alias("contrast"), "pos_hits", "neg_hits").filter(F.col("contrast") >= threshold)


def pattern_matrix(found: DataFrame, contrasts: DataFrame, most: int) -> DataFrame:
    """run_id and a column seq_00, seq_01, ... for each of the `most` patterns with the highest contrast (to nine digits;
    ties by their tokens): whether the run's sequence holds it. Where there are fewer patterns, the last columns are 0."""
    best = contrasts.withColumn("_name", F.array_join("pattern", ">")).orderBy(F.round("contrast", 9).desc(), "_name").limit(most).select("pattern").collect()
    columns = [holds(F.col("sequence"), F.array(*[F.lit(t) for t in r[0]])).cast("int") for r in best] + [F.lit(0)] * (most - len(best))
    return found.select("run_id", *[c.alias(f"seq_{i:02d}") for i, c in enumerate(columns)])
