"""Per-run operators over an event log (run_id, pos, kind, category, api, target, ts, size).

Order is `pos`, never time, except where a docstring says so. Each operator has a least amount of evidence under which
its columns are NULL; thresholds are parameters. Sets of targets are compared by flags per target, so no run's targets
are gathered into an array.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.safe import entropy, pearson, ratio, upper_median, variation
from tidemark.sources.shared import bucketed


def _by() -> Window:
    return Window.partitionBy("run_id").orderBy("pos")


def _least(n: Column, least: int, x: Column) -> Column:
    return F.when(n >= least, x)


def transitions(log: DataFrame, group_a: list[str], group_b: list[str]) -> DataFrame:
    """Bigrams of api in order: numbers of distinct ones, branching, entropy, top share, passages between two groups of
    categories, and the rate of category switches. A run with one call has zeros, as an observed absence."""
    pairs = log.select("run_id", "api", "category", F.lead("api").over(_by()).alias("next_api"), F.lead("category").over(_by()).alias("next_category"))
    in_a, in_b = (lambda c: F.col(c).isin(group_a)), (lambda c: F.col(c).isin(group_b))
    kinds = F.struct("category", "next_category")
    # All groupings keep to the runs that the window has dealt out, so there is one shuffle.
    by_pair = pairs.groupBy("run_id", "api", "next_api").agg(
        F.count(F.lit(1)).alias("c"),
        F.count_if(in_a("category") & in_b("next_category")).alias("a_to_b"),
        F.count_if(in_b("category") & in_a("next_category")).alias("b_to_a"),
        F.count_if(F.col("category") != F.col("next_category")).alias("switches"),
        F.collect_set(F.when(F.col("next_category").isNotNull(), kinds)).alias("kinds"),  # pairs of categories, which are few
    )
    paired, c = F.col("next_api").isNotNull(), F.col("c")
    out = by_pair.groupBy("run_id").agg(
        F.size(F.collect_set("api")).alias("n_apis"),  # names of APIs, which are some hundreds
        F.sum(F.when(paired, c)).alias("total"),
        F.count_if(paired).alias("n_bigrams"),
        F.max(F.when(paired, c)).alias("top"),
        F.sum(F.when(paired, c * F.log2("c"))).alias("clogc"),
        *[F.sum(x).alias(x) for x in ("a_to_b", "b_to_a", "switches")],
        F.size(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("n_category_bigrams"),
    )
    zero = lambda c, kind="long": F.coalesce(c, F.lit(0)).cast(kind)
    return out.select(
        "run_id",
        F.when(F.col("total").isNotNull(), F.col("n_apis")).otherwise(0).cast("long").alias("n_apis"),
        zero(F.col("n_bigrams")).alias("n_bigrams"),
        zero(ratio(F.col("n_bigrams"), F.col("n_apis")), "double").alias("branching"),
        zero(F.log2(F.col("total")) - ratio(F.col("clogc"), F.col("total")), "double").alias("bigram_entropy"),
        zero(ratio(F.col("top"), F.col("total")), "double").alias("top_bigram_share"),
        zero(F.col("a_to_b")).alias("a_to_b"),
        zero(F.col("b_to_a")).alias("b_to_a"),
        zero(F.least("a_to_b", "b_to_a")).alias("interleave"),
        zero(F.col("n_category_bigrams")).alias("n_category_bigrams"),
        zero(ratio(F.col("switches"), F.col("total")), "double").alias("switch_rate"),
    )


def target_flags(log: DataFrame, keys: tuple[str, ...] = ("run_id", "target")) -> DataFrame:
    """One row per run and target with a flag for each kind of event that it saw."""
    flag = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    return log.groupBy(*keys).agg(flag("read").alias("r"), flag("write").alias("w"), flag("delete").alias("d"), flag("move").alias("m"), flag("delete", "move").alias("x"), F.count(F.lit(1)).alias("n_events"))


def chain_shapes(log: DataFrame) -> DataFrame:
    """Which kinds of event each target saw, as shares of the run's targets; order plays no part."""
    x = F.col("x")
    shape = (
        F.when(F.col("r") & F.col("w") & x, "full")
        .when(F.col("r") & F.col("w"), "read_write")
        .when(F.col("r") & x, "read_destroy")
        .when(F.col("w") & x, "write_destroy")
        .when(F.col("r"), "read_only")
        .when(F.col("w"), "write_only")
        .otherwise("other")
    )
    names = ["full", "read_write", "read_destroy", "write_destroy", "read_only", "write_only", "other"]
    counts = target_flags(log).select("run_id", shape.alias("shape")).groupBy("run_id", "shape").agg(F.count(F.lit(1)).alias("c"))
    one = lambda s: F.coalesce(F.max(F.when(F.col("shape") == s, F.col("c"))), F.lit(0))
    return counts.groupBy("run_id").agg(
        F.sum("c").alias("n_targets"),
        *[ratio(one(s), F.sum("c")).alias(f"chain_{s}") for s in names],
        F.count(F.lit(1)).alias("n_shapes"),
        ratio(F.max("c"), F.sum("c")).alias("top_shape_share"),
    )


def set_relations(log: DataFrame) -> DataFrame:
    """How the sets of read, written and deleted targets of a run overlap; NULL where a set that is divided by is empty."""
    n = lambda c: F.count_if(c)
    r, w, d = F.col("r"), F.col("w"), F.col("d")
    return target_flags(log).groupBy("run_id").agg(
        ratio(n(r & w), n(r | w)).alias("rw_jaccard"),
        ratio(n(w & ~r), n(w)).alias("write_not_read"),
        ratio(n(r & ~w), n(r)).alias("read_not_write"),
        ratio(n(r & d), n(r)).alias("read_then_destroy"),
        ratio(n(w & d), n(w)).alias("write_then_destroy"),
        ratio(n(w), n(r)).alias("rw_size_ratio"),
    )


def selectivity(log: DataFrame, group: Column, groups: list[str], system: list[str], least: int = 3, least_system: int = 5) -> DataFrame:
    """Touched and destroyed targets by group: rates (of groups with `least` touched), their spread (of two rates or
    more), shares of what was destroyed, whether system groups were spared, and their share of what was touched."""
    t = target_flags(log.withColumn("_group", group), ("run_id", "target", "_group"))
    hit = lambda g: F.count_if(F.col("_group") == g)
    gone = lambda g: F.count_if((F.col("_group") == g) & F.col("x"))
    sums = t.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("touched"),
        F.count_if("x").alias("destroyed"),
        *[hit(g).alias(f"touched_{g}") for g in groups],
        *[gone(g).alias(f"destroyed_{g}") for g in groups],
        F.count_if(F.col("_group").isin(system)).alias("sys_touched"),
        F.count_if(F.col("_group").isin(system) & F.col("x")).alias("sys_destroyed"),
    )
    rates = {g: F.when(F.col(f"touched_{g}") >= least, ratio(F.col(f"destroyed_{g}"), F.col(f"touched_{g}"))) for g in groups}
    known = sum((rates[g].isNotNull().cast("int") for g in groups), F.lit(0))
    user_destroyed = F.col("destroyed") - F.col("sys_destroyed")
    return sums.select(
        "run_id",
        *[rates[g].alias(f"rate_{g}") for g in groups],
        F.when(known >= 2, F.greatest(*rates.values()) - F.least(*rates.values())).alias("rate_spread"),
        (rates[groups[0]] - rates[groups[1]]).alias("rate_first_minus_second"),
        *[ratio(F.col(f"destroyed_{g}"), F.col("destroyed")).alias(f"share_{g}") for g in groups],
        F.when(F.col("sys_touched") >= least_system, ((F.col("sys_destroyed") == 0) & (user_destroyed > 0)).cast("int")).alias("system_spared"),
        ratio(F.col("sys_touched"), F.col("touched")).alias("system_touch_share"),
    )


def variety(log: DataFrame, values: list[Column], prefix: str) -> DataFrame:
    """Distinct values of several columns taken together, and the share of the commonest one."""
    each = log.select("run_id", F.explode(F.array_compact(F.array(*values))).alias("v")).filter("v <> ''")
    counts = each.groupBy("run_id", "v").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("run_id").agg(F.count(F.lit(1)).alias(f"{prefix}_distinct"), ratio(F.max("c"), F.sum("c")).alias(f"{prefix}_top_share"))


def transition_matrix(log: DataFrame, categories: list[str], least: int = 50, apart_us: int = 1_000, longest_us: int = 60_000_000, least_gaps: int = 5) -> DataFrame:
    """Shares of all pairs of adjacent categories, and how often the two are apart in time. Calls of other categories are
    left out before adjacency is taken. Columns are `shift_` and `apart_` with the first four letters of both."""
    kept = log.filter(F.col("category").isin(categories)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("run_id"))).filter(F.col("n") >= least)
    pairs = kept.select("run_id", F.col("category").alias("a"), F.lead("category").over(_by()).alias("b"), (F.lead("ts").over(_by()) - F.col("ts")).alias("gap")).filter("b is not null")
    near = (F.col("gap") >= 0) & (F.col("gap") < longest_us)
    per = pairs.groupBy("run_id", "a", "b").agg(F.count(F.lit(1)).alias("c"), F.count_if(near).alias("gaps"), F.count_if(near & (F.col("gap") >= apart_us)).alias("apart"))
    cells = [(a, b, f"{a[:4]}_{b[:4]}") for a in categories for b in categories]
    pick = lambda a, b, x: F.max(F.when((F.col("a") == a) & (F.col("b") == b), x))
    return per.groupBy("run_id").agg(
        *[ratio(F.coalesce(pick(a, b, F.col("c")), F.lit(0)), F.sum("c")).alias(f"shift_{n}") for a, b, n in cells],
        *[pick(a, b, F.when(F.col("gaps") >= least_gaps, ratio(F.col("apart"), F.col("gaps")))).alias(f"apart_{n}") for a, b, n in cells],
    )


def byte_volume(log: DataFrame, out_kinds: list[str], in_kinds: list[str], most: float = float(1 << 30)) -> DataFrame:
    """Sizes out and in: totals, ratio, means, and the share of writes at the commonest size."""
    ok = log.filter(F.col("size").between(0, most))
    out, into = F.col("kind").isin(out_kinds), F.col("kind").isin(in_kinds)
    sums = ok.groupBy("run_id").agg(
        F.sum(F.when(out, F.col("size"))).alias("bytes_out"),
        F.sum(F.when(into, F.col("size"))).alias("bytes_in"),
        F.avg(F.when(out, F.col("size"))).alias("mean_out"),
        F.avg(F.when(into, F.col("size"))).alias("mean_in"),
    )
    modes = ok.filter(out).groupBy("run_id", "size").agg(F.count(F.lit(1)).alias("c")).groupBy("run_id").agg(ratio(F.max("c"), F.sum("c")).alias("modal_share"))
    return sums.join(modes, "run_id", "left").select("run_id", "bytes_out", "bytes_in", ratio(F.col("bytes_out"), F.col("bytes_in")).alias("out_in_ratio"), "mean_out", "mean_in", "modal_share")


def read_write_pairs(log: DataFrame, longest_us: int = 600_000_000) -> DataFrame:
    """run_id, target and gap of each read that a write answers: the first read since the last write of the target is
    armed, and the next write takes it. Reads and writes alone count; rows without a time are left out first."""
    by = Window.partitionBy("run_id", "target").orderBy("pos")
    rows = log.filter(F.col("kind").isin("read", "write") & F.col("ts").isNotNull() & F.col("target").isNotNull())
    epoch = F.coalesce(F.sum((F.col("kind") == "write").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = rows.withColumn("epoch", epoch).groupBy("run_id", "target", "epoch").agg(
        F.min_by("ts", F.when(F.col("kind") == "read", F.col("pos"))).alias("read_ts"), F.max(F.when(F.col("kind") == "write", F.col("ts"))).alias("write_ts"), F.bool_or(F.col("kind") == "read").alias("armed")
    )
    gap = F.col("write_ts") - F.col("read_ts")
    return per.filter(F.col("armed") & F.col("write_ts").isNotNull()).select("run_id", "target", gap.alias("gap")).filter((F.col("gap") >= 0) & (F.col("gap") < longest_us))


def read_write_latency(log: DataFrame, least: int = 5, longest_us: int = 600_000_000, short_us: int = 100_000) -> DataFrame:
    """Upper median in ms, variation, share of short ones and number of the pairs of `read_write_pairs`."""
    n = F.count(F.lit(1))
    runs = log.select("run_id").distinct()
    per = read_write_pairs(log, longest_us).groupBy("run_id").agg(
        _least(n, least, upper_median("gap") / 1000.0).alias("latency_median_ms"),
        _least(n, least, variation(F.col("gap"))).alias("latency_cv"),
        _least(n, least, ratio(F.count_if(F.col("gap") < short_us), n)).alias("latency_short_share"),
        _least(n, least, n).alias("latency_pairs"),
    )
    return runs.join(per, "run_id", "left")


def walk(log: DataFrame, place: Column, least: int = 10) -> DataFrame:
    """Runs of events in one place: rate of staying, switches, revisits, length of a run, distinct places."""
    steps = log.withColumn("place", place).filter("place is not null").select("run_id", "place", (F.lag("place").over(_by()) != F.col("place")).cast("int").alias("moved"))
    per = steps.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("moved"), F.lit(0)).alias("switches"), F.count_distinct("place").alias("places"))
    n, runs = F.col("n"), F.col("switches") + 1
    return per.select(
        "run_id",
        _least(n, least, 1 - ratio(F.col("switches"), n - 1)).alias("walk_same_rate"),
        _least(n, least, F.col("switches")).cast("long").alias("walk_switches"),
        _least(n, least, ratio(runs - F.col("places"), runs)).alias("walk_revisit_rate"),
        _least(n, least, ratio(n, runs)).alias("walk_run_length"),
        _least(n, least, F.col("places")).alias("walk_places"),
    )


def rhythm(log: DataFrame, least: int = 20, least_gaps: int = 10, short_us: int = 100_000) -> DataFrame:
    """Gaps between events in the order of time: variation, upper median in ms, shares of gaps up to it and of short ones."""
    gaps = log.filter("ts is not null").select("run_id", (F.col("ts") - F.lag("ts").over(Window.partitionBy("run_id").orderBy("ts"))).alias("gap"))
    # Places by gap, in the runs that are dealt out already: the median is the gap at place g // 2.
    by = Window.partitionBy("run_id").orderBy(F.col("gap").asc_nulls_last())
    placed = gaps.withColumn("place", F.row_number().over(by) - 1).withColumn("g", F.count("gap").over(Window.partitionBy("run_id")))
    middle = F.max(F.when(F.col("place") == F.floor(F.col("g") / 2), F.col("gap"))).over(Window.partitionBy("run_id"))
    per = placed.withColumn("mid", middle).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("g").alias("g"), variation(F.col("gap")).alias("cv"), F.max("mid").alias("mid"), F.count_if(F.col("gap") < short_us).alias("short"), F.count_if(F.col("gap") <= F.col("mid")).alias("below")
    )
    ok = lambda x: F.when((F.col("n") >= least) & (F.col("g") >= least_gaps), x)
    return per.select(
        "run_id", ok(F.col("cv")).alias("gap_cv"), ok(F.col("mid") / 1000.0).alias("gap_median_ms"), ok(ratio(F.col("below"), F.col("g"))).alias("gap_regular_share"), ok(ratio(F.col("short"), F.col("g"))).alias("gap_burst_share")
    )


def lifecycle(log: DataFrame) -> DataFrame:
    """Counts of each kind of event, deletes and moves per write, and distinct destroyed targets; untimed rows left out."""
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    return log.filter("ts is not null").groupBy("run_id").agg(
        *[n(k).alias(f"n_{k}") for k in ("read", "write", "delete", "move", "copy", "execute")],
        ratio(n("delete"), n("write")).alias("delete_write_ratio"),
        ratio(n("move"), n("write")).alias("move_write_ratio"),
        F.count_distinct(F.when(F.col("kind").isin("delete", "move"), F.col("target"))).alias("n_destroyed_targets"),
    )


def window_chains(log: DataFrame, width_us: int = 1_000_000) -> DataFrame:
    """Tumbling windows that begin at the run's first event: active ones, those with a read, a write and a destruction,
    those with writes alone, and others."""
    anchored = log.filter("ts is not null").withColumn("bin", F.floor((F.col("ts") - F.min("ts").over(Window.partitionBy("run_id"))) / width_us))
    per = target_flags(anchored, ("run_id", "bin"))
    chain, alone = F.col("r") & F.col("w") & F.col("x"), F.col("w") & ~F.col("r") & ~F.col("x")
    return per.groupBy("run_id").agg(F.count(F.lit(1)).alias("win_active"), F.count_if(chain).alias("win_chain"), F.count_if(alone).alias("win_write_only"), F.count_if(~chain & ~alone).alias("win_other"))


def window_correlation(log: DataFrame, a: Column, b: Column, width_us: int = 1_000_000) -> DataFrame:
    """Pearson correlation of two counts per window, over all windows from the first to the last event of either; windows
    without events count as zeros, which needs their number alone, not a row for each."""
    both = log.filter("ts is not null").select("run_id", "ts", a.cast("long").alias("a"), b.cast("long").alias("b")).filter("a + b > 0")
    binned = both.withColumn("bin", F.floor((F.col("ts") - F.min("ts").over(Window.partitionBy("run_id"))) / width_us))
    per = binned.groupBy("run_id", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    s = per.groupBy("run_id").agg(*[F.sum(e).cast("double").alias(n) for n, e in (("sa", F.col("a")), ("sb", F.col("b")), ("saa", F.col("a") * F.col("a")), ("sbb", F.col("b") * F.col("b")), ("sab", F.col("a") * F.col("b")))], (F.max("bin") + 1).cast("double").alias("n"))
    va, vb = F.col("n") * F.col("saa") - F.col("sa") ** 2, F.col("n") * F.col("sbb") - F.col("sb") ** 2
    return s.select("run_id", ratio(F.col("n") * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt(va * vb)).alias("window_correlation"))


class _Squeezed:
    """A run's stream of calls as it is compressed: the compressor, and the apis seen in their order."""

    def __init__(self, run_id: int):
        self.run_id, self.n, self.size, self.seen = run_id, 0, 0, {}
        self.held, self.squeezer = bytearray(), zlib.compressobj(6)

    def add(self, api: str | None) -> None:
        self.n += 1
        self.held.append(self.seen.setdefault(api, len(self.seen)) % 256)
        if len(self.held) >= 4_096:
            self._squeeze()

    def _squeeze(self) -> None:
        self.size += len(self.squeezer.compress(bytes(self.held)))
        self.held.clear()

    def row(self) -> dict:
        self._squeeze()
        return {"run_id": self.run_id, "n_calls": self.n, "repetitiveness": round((self.size + len(self.squeezer.flush())) / self.n, 5)}


def repetitiveness(log: DataFrame, most: int = 200_000) -> DataFrame:
    """Size of the zlib-compressed stream of a run's first `most` calls over its length; each api is the order of its first
    occurrence, modulo 256. run_id, n_calls, repetitiveness.

    Calls are sorted by run and place in their partitions and read as a stream: a compressor and the apis seen go from batch
    to batch, so no run is ever gathered."""
    schema = pa.schema([("run_id", pa.int64()), ("n_calls", pa.int64()), ("repetitiveness", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            ready = []
            for run_id, api in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is None or now.run_id != run_id:
                    if now:
                        ready.append(now.row())
                    now = _Squeezed(run_id)
                if now.n < most:
                    now.add(api)
            yield pa.RecordBatch.from_pylist(ready, schema)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    calls = log.select(F.col("run_id").cast("long").alias("run_id"), "api", "pos").repartition("run_id").sortWithinPartitions("run_id", "pos")
    return calls.select("run_id", "api").mapInArrow(run, "run_id long, n_calls long, repetitiveness double")


def relational_table(log: DataFrame, parts: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """One row per run: run_id, n_calls, and of each part, an operator on the log with at most one row per run, its columns
    under its name; NULL where it has no row.

    The log is dealt by run once and written as buckets to the shared folder: the parts read it from there, and their windows
    and groups by run need no further shuffle. Each part's rows are written as such buckets too before the next part is worked
    out, so a task holds the sorted log of one part at a time."""
    rows = log.count()
    once = bucketed(log, "run_id", "log", rows)
    out = once.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_calls"))
    for name, part in parts.items():
        found = part(once)
        found = found.select("run_id", *[F.col(c).alias(f"{name}_{c}") for c in found.columns if c != "run_id"])
        out = out.join(bucketed(found, "run_id", name, rows), "run_id", "left")
    return out


def call_entropy(log: DataFrame, value: str) -> DataFrame:
    """Shannon entropy in bits of the values of a column in each run."""
    counts = log.groupBy("run_id", value).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("run_id").agg(F.sum("c").alias("t"))
    return counts.join(totals, "run_id").groupBy("run_id").agg(entropy(F.col("c"), F.col("t")).alias("entropy_bits"))


def dense_correlation(log: DataFrame, a: Column, b: Column, width_us: int) -> DataFrame:
    """As `window_correlation`, with a row for every window; for short runs, and to check the other."""
    both = log.select("run_id", "ts", a.cast("long").alias("a"), b.cast("long").alias("b")).filter("a + b > 0")
    binned = both.withColumn("bin", F.floor((F.col("ts") - F.min("ts").over(Window.partitionBy("run_id"))) / width_us))
    per = binned.groupBy("run_id", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    grid = per.groupBy("run_id").agg(F.max("bin").alias("last")).select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    full = grid.join(per, ["run_id", "bin"], "left").fillna(0, ["a", "b"])
    return full.groupBy("run_id").agg(pearson(F.col("a"), F.col("b")).alias("window_correlation"))
