"""Queries of the per-run operators on the driver's events (thresholds scaled to events that are hours apart)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import behaviour
from tidemark.operators import events as ops
from tidemark.operators import sequences as seq
from tidemark.plans.registry import SQL, query
from tidemark.sources.testdata import EVENT_LOG_SQL as EV
from tidemark.sources.testdata import event_log

DAY = 86_400_000_000
HOUR = DAY // 24
CATEGORIES = ["view", "click", "purchase", "error", "signup"]


def _log(spark: SparkSession, sf: str, log: DataFrame | None) -> DataFrame:
    return event_log(spark, sf) if log is None else log


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("o01_api_stream", EV + "SELECT run_id, pos, api FROM ev")
def api_stream(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).select("run_id", "pos", "api")


@query(
    "o02_transitions",
    EV
    + """, p AS (SELECT run_id, api, category, lead(api) OVER w AS nb, lead(category) OVER w AS nc FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
b AS (SELECT run_id, api, nb, count(*) AS c FROM p WHERE nb IS NOT NULL GROUP BY ALL),
t AS (SELECT run_id, sum(c) AS total, count(*) AS n, max(c) AS top, sum(c * log2(c)) AS cl FROM b GROUP BY run_id),
k AS (SELECT run_id, count(*) FILTER (category IN ('view', 'click') AND nc = 'error') AS ab, count(*) FILTER (category = 'error' AND nc IN ('view', 'click')) AS ba,
 count(*) FILTER (category <> nc) AS sw, count(DISTINCT category || '>' || nc) AS ncb FROM p WHERE nb IS NOT NULL GROUP BY run_id),
a AS (SELECT run_id, count(DISTINCT api) AS na FROM ev GROUP BY run_id)
SELECT a.run_id, CAST(CASE WHEN total IS NULL THEN 0 ELSE na END AS BIGINT) AS n_apis, CAST(coalesce(n, 0) AS BIGINT) AS n_bigrams, round(coalesce(n / CAST(na AS DOUBLE), 0), 6) AS branching,
 round(coalesce(log2(total) - cl / total, 0), 6) AS bigram_entropy, round(coalesce(top / CAST(total AS DOUBLE), 0), 6) AS top_bigram_share,
 CAST(coalesce(ab, 0) AS BIGINT) AS a_to_b, CAST(coalesce(ba, 0) AS BIGINT) AS b_to_a, CAST(coalesce(least(ab, ba), 0) AS BIGINT) AS interleave,
 CAST(coalesce(ncb, 0) AS BIGINT) AS n_category_bigrams, round(coalesce(sw / CAST(total AS DOUBLE), 0), 6) AS switch_rate
FROM a LEFT JOIN t USING (run_id) LEFT JOIN k USING (run_id)""",
)
def transitions(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    return _rounded(ops.transitions(_log(spark, sf, log), ["view", "click"], ["error"]))


@query("o03_repetitiveness")
def repetitiveness(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    return ops.repetitiveness(_log(spark, sf, log))


FLAGS = """, f AS (SELECT run_id, target, bool_or(kind = 'read') AS r, bool_or(kind = 'write') AS w, bool_or(kind = 'delete') AS d, bool_or(kind = 'move') AS m, bool_or(kind IN ('delete', 'move')) AS x FROM ev GROUP BY ALL)
"""
SHAPES = ["full", "read_write", "read_destroy", "write_destroy", "read_only", "write_only", "other"]


@query(
    "o04_chain_shapes",
    EV
    + FLAGS
    + """, s AS (SELECT run_id, CASE WHEN r AND w AND x THEN 'full' WHEN r AND w THEN 'read_write' WHEN r AND x THEN 'read_destroy' WHEN w AND x THEN 'write_destroy' WHEN r THEN 'read_only' WHEN w THEN 'write_only' ELSE 'other' END AS shape, count(*) AS c FROM f GROUP BY ALL)
SELECT run_id, CAST(sum(c) AS BIGINT) AS n_targets, """
    + ", ".join(f"round(coalesce(sum(c) FILTER (shape = '{s}'), 0) / CAST(sum(c) AS DOUBLE), 6) AS chain_{s}" for s in SHAPES)
    + ", count(*) AS n_shapes, round(max(c) / CAST(sum(c) AS DOUBLE), 6) AS top_shape_share FROM s GROUP BY run_id",
)
def chain_shapes(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    return _rounded(ops.chain_shapes(_log(spark, sf, log)))


def _sel(g: str) -> str:
    return f"CASE WHEN t{g} >= 3 THEN d{g} / CAST(t{g} AS DOUBLE) END"


@query(
    "o05_selectivity",
    EV
    + """, f AS (SELECT run_id, target, target % 3 AS g, bool_or(kind IN ('delete', 'move')) AS x FROM ev GROUP BY ALL),
s AS (SELECT run_id, count(*) AS n, count(*) FILTER (x) AS d, count(*) FILTER (g = 0) AS t0, count(*) FILTER (g = 0 AND x) AS d0, count(*) FILTER (g = 1) AS t1, count(*) FILTER (g = 1 AND x) AS d1, count(*) FILTER (g = 2) AS t2, count(*) FILTER (g = 2 AND x) AS d2 FROM f GROUP BY run_id),
r AS (SELECT *, """
    + ", ".join(f"{_sel(g)} AS r{g}" for g in "012")
    + """ FROM s)
SELECT run_id, round(r0, 6) AS rate_0, round(r1, 6) AS rate_1, round(r2, 6) AS rate_2,
 round(CASE WHEN (r0 IS NOT NULL)::INT + (r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT >= 2 THEN greatest(r0, r1, r2) - least(r0, r1, r2) END, 6) AS rate_spread,
 round(r0 - r1, 6) AS rate_first_minus_second, round(d0 / CAST(nullif(d, 0) AS DOUBLE), 6) AS share_0, round(d1 / CAST(nullif(d, 0) AS DOUBLE), 6) AS share_1, round(d2 / CAST(nullif(d, 0) AS DOUBLE), 6) AS share_2,
 CASE WHEN t2 >= 2 THEN CAST(d2 = 0 AND d - d2 > 0 AS INT) END AS system_spared, round(t2 / CAST(n AS DOUBLE), 6) AS system_touch_share FROM r""",
)
def selectivity(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    return _rounded(ops.selectivity(_log(spark, sf, log), (F.col("target") % 3).cast("string"), ["0", "1", "2"], ["2"], least_system=2))


@query(
    "o06_variety",
    EV + ", v AS (SELECT run_id, unnest([api, category]) AS v FROM ev), c AS (SELECT run_id, v, count(*) AS c FROM v GROUP BY ALL) SELECT run_id, count(*) AS ext_distinct, round(max(c) / CAST(sum(c) AS DOUBLE), 6) AS ext_top_share FROM c GROUP BY run_id",
)
def variety(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    return _rounded(ops.variety(_log(spark, sf, log), [F.col("api"), F.col("category")], "ext"))


@query(
    "o07_stages",
    EV
    + """, m AS (SELECT run_id, kind AS stage, min(ts) AS ts FROM ev WHERE kind IN ('read', 'write', 'delete', 'move') GROUP BY ALL
 UNION ALL SELECT run_id, 'large', min(ts) FROM ev WHERE size >= 100 GROUP BY run_id UNION ALL SELECT run_id, 'first_target', min(ts) FROM ev WHERE target = 0 GROUP BY run_id)
SELECT run_id, count(*) AS n_stages, count(*) FILTER (stage NOT IN ('move', 'delete')) AS n_stages_clean, """
    + ", ".join(f"CAST(bool_or(stage = '{s}') AS INT) AS stage_{s}" for s in ["read", "write", "delete", "move", "large", "first_target"])
    + ", count(ts) AS n_timed, round(CASE WHEN count(ts) >= 2 THEN (max(ts) - min(ts)) / 1000000.0 END, 2) AS stage_span_s FROM m GROUP BY run_id",
)
def stages(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    rules = {k: F.col("kind") == k for k in ("read", "write", "delete", "move")} | {"large": F.col("size") >= 100, "first_target": F.col("target") == 0}
    return _rounded(seq.stage_features(_log(spark, sf, log), rules, unclean=["move", "delete"]), 2)


@query(
    "o08_set_relations",
    EV
    + FLAGS
    + """SELECT run_id, round(count(*) FILTER (r AND w) / CAST(nullif(count(*) FILTER (r OR w), 0) AS DOUBLE), 6) AS rw_jaccard, round(count(*) FILTER (w AND NOT r) / CAST(nullif(count(*) FILTER (w), 0) AS DOUBLE), 6) AS write_not_read,
 round(count(*) FILTER (r AND NOT w) / CAST(nullif(count(*) FILTER (r), 0) AS DOUBLE), 6) AS read_not_write, round(count(*) FILTER (r AND d) / CAST(nullif(count(*) FILTER (r), 0) AS DOUBLE), 6) AS read_then_destroy,
 round(count(*) FILTER (w AND d) / CAST(nullif(count(*) FILTER (w), 0) AS DOUBLE), 6) AS write_then_destroy, round(count(*) FILTER (w) / CAST(nullif(count(*) FILTER (r), 0) AS DOUBLE), 6) AS rw_size_ratio FROM f GROUP BY run_id""",
)
def set_relations(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    return _rounded(ops.set_relations(_log(spark, sf, log)))


_CELLS = [(a, b, f"{a[:4]}_{b[:4]}") for a in CATEGORIES for b in CATEGORIES]


@query(
    "o09_transition_matrix",
    EV
    + f""", k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM ev) WHERE n >= 50),
p AS (SELECT run_id, category AS a, lead(category) OVER w AS b, lead(ts) OVER w - ts AS gap FROM k WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
c AS (SELECT run_id, a, b, count(*) AS c, count(*) FILTER (gap >= 0 AND gap < {10 * DAY}) AS g, count(*) FILTER (gap >= {DAY} AND gap < {10 * DAY}) AS ap FROM p WHERE b IS NOT NULL GROUP BY ALL)
SELECT run_id, """
    + ", ".join(f"round(coalesce(max(CASE WHEN a = '{a}' AND b = '{b}' THEN c END), 0) / CAST(sum(c) AS DOUBLE), 6) AS shift_{n}" for a, b, n in _CELLS)
    + ", "
    + ", ".join(f"round(max(CASE WHEN a = '{a}' AND b = '{b}' AND g >= 3 THEN ap / CAST(g AS DOUBLE) END), 6) AS apart_{n}" for a, b, n in _CELLS)
    + " FROM c GROUP BY run_id",
)
def transition_matrix(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    return _rounded(ops.transition_matrix(_log(spark, sf, log), CATEGORIES, apart_us=DAY, longest_us=10 * DAY, least_gaps=3))


@query(
    "o10_byte_volume",
    EV
    + """, s AS (SELECT run_id, sum(size) FILTER (kind IN ('write', 'move')) AS o, sum(size) FILTER (kind = 'read') AS i, avg(size) FILTER (kind IN ('write', 'move')) AS mo, avg(size) FILTER (kind = 'read') AS mi FROM ev WHERE size BETWEEN 0 AND 1073741824 GROUP BY run_id),
m AS (SELECT run_id, max(c) / CAST(sum(c) AS DOUBLE) AS ms FROM (SELECT run_id, size, count(*) AS c FROM ev WHERE kind IN ('write', 'move') AND size BETWEEN 0 AND 1073741824 GROUP BY ALL) GROUP BY run_id)
SELECT run_id, round(o, 3) AS bytes_out, round(i, 3) AS bytes_in, round(o / nullif(i, 0), 3) AS out_in_ratio, round(mo, 3) AS mean_out, round(mi, 3) AS mean_in, round(ms, 3) AS modal_share FROM s LEFT JOIN m USING (run_id)""",
)
def byte_volume(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    return _rounded(ops.byte_volume(_log(spark, sf, log), ["write", "move"], ["read"]), 3)


PAIRS = f""", q AS (SELECT *, coalesce(sum(CAST(kind = 'write' AS INT)) OVER (PARTITION BY run_id, target ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM ev WHERE kind IN ('read', 'write')),
g AS (SELECT run_id, target, max(ts) FILTER (kind = 'write') - min_by(ts, pos) FILTER (kind = 'read') AS gap FROM q GROUP BY run_id, target, ep),
pr AS (SELECT * FROM g WHERE gap >= 0 AND gap < {10 * DAY})
"""


@query(
    "o11_read_write_latency",
    EV
    + PAIRS
    + f""", z AS (SELECT run_id, count(*) AS n, list_sort(list(gap)) AS l, stddev_pop(gap) / nullif(avg(gap), 0) AS cv, count(*) FILTER (gap < {DAY}) AS s FROM pr GROUP BY run_id)
SELECT r.run_id, round(CASE WHEN n >= 2 THEN l[n // 2 + 1] / 1000.0 END, 3) AS latency_median_ms, round(CASE WHEN n >= 2 THEN cv END, 6) AS latency_cv, round(CASE WHEN n >= 2 THEN s / CAST(n AS DOUBLE) END, 6) AS latency_short_share, CASE WHEN n >= 2 THEN n END AS latency_pairs
FROM (SELECT DISTINCT run_id FROM ev) r LEFT JOIN z USING (run_id)""",
)
def read_write_latency(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    out = ops.read_write_latency(_log(spark, sf, log), least=2, longest_us=10 * DAY, short_us=DAY)
    return _rounded(out.withColumn("latency_median_ms", F.round(F.col("latency_median_ms").cast("double"), 3)))


@query(
    "j12_read_write_pairs",
    EV + PAIRS + "SELECT run_id, target, CAST(gap AS BIGINT) AS gap FROM pr",
)
def read_write_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return ops.read_write_pairs(event_log(spark, sf), 10 * DAY)


@query(
    "o12_walk",
    EV
    + """, s AS (SELECT run_id, target, CAST(lag(target) OVER (PARTITION BY run_id ORDER BY pos) <> target AS INT) AS mv FROM ev),
p AS (SELECT run_id, count(*) AS n, coalesce(sum(mv), 0) AS sw, count(DISTINCT target) AS pl FROM s GROUP BY run_id)
SELECT run_id, round(CASE WHEN n >= 60 THEN 1 - sw / CAST(n - 1 AS DOUBLE) END, 6) AS walk_same_rate, CAST(CASE WHEN n >= 60 THEN sw END AS BIGINT) AS walk_switches, round(CASE WHEN n >= 60 THEN (sw + 1 - pl) / CAST(sw + 1 AS DOUBLE) END, 6) AS walk_revisit_rate,
 round(CASE WHEN n >= 60 THEN n / CAST(sw + 1 AS DOUBLE) END, 6) AS walk_run_length, CASE WHEN n >= 60 THEN pl END AS walk_places FROM p""",
)
def walk(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    return _rounded(ops.walk(_log(spark, sf, log), F.col("target"), least=60))


@query(
    "o13_rhythm",
    EV
    + f""", g AS (SELECT run_id, ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) AS gap FROM ev),
p AS (SELECT run_id, count(*) AS n, count(gap) AS k, stddev_pop(gap) / nullif(avg(gap), 0) AS cv, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l, count(*) FILTER (gap < {HOUR}) AS s FROM g GROUP BY run_id),
b AS (SELECT run_id, count(*) FILTER (gap <= l[k // 2 + 1]) AS b FROM g JOIN p USING (run_id) GROUP BY run_id)
SELECT run_id, round(CASE WHEN n >= 20 AND k >= 10 THEN cv END, 6) AS gap_cv, round(CASE WHEN n >= 20 AND k >= 10 THEN l[k // 2 + 1] / 1000.0 END, 3) AS gap_median_ms, round(CASE WHEN n >= 20 AND k >= 10 THEN b / CAST(k AS DOUBLE) END, 6) AS gap_regular_share, round(CASE WHEN n >= 20 AND k >= 10 THEN s / CAST(k AS DOUBLE) END, 6) AS gap_burst_share
FROM p JOIN b USING (run_id)""",
)
def rhythm(spark: SparkSession, sf: str, log: DataFrame | None = None) -> DataFrame:
    out = ops.rhythm(_log(spark, sf, log), short_us=HOUR)
    return _rounded(out.withColumn("gap_median_ms", F.round(F.col("gap_median_ms").cast("double"), 3)))


#: What makes up a run's row, beside the number of its calls; repetitiveness has no SQL.
RELATIONAL = {
    "o02_transitions": transitions, "o04_chain_shapes": chain_shapes, "o05_selectivity": selectivity, "o06_variety": variety,
    "o07_stages": stages, "o08_set_relations": set_relations, "o09_transition_matrix": transition_matrix, "o10_byte_volume": byte_volume,
    "o11_read_write_latency": read_write_latency, "o12_walk": walk, "o13_rhythm": rhythm,
}


@query(
    "b01_relational_table",
    EV
    + "SELECT * FROM (SELECT run_id, count(*) AS n_calls FROM ev GROUP BY run_id)"
    + "".join(f" LEFT JOIN (SELECT run_id, COLUMNS(* EXCLUDE (run_id)) AS '{name[:3]}_\\0' FROM ({SQL[name]})) USING (run_id)" for name in RELATIONAL),
)
def relational_table(spark: SparkSession, sf: str) -> DataFrame:
    """The operators on calls and events of a run as one row, from one copy of the log."""
    parts = {name[:3]: lambda log, f=f: f(spark, sf, log) for name, f in RELATIONAL.items()}
    return ops.relational_table(event_log(spark, sf), parts)


@query(
    "o14_lifecycle",
    EV
    + "SELECT run_id, "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("read", "write", "delete", "move", "copy", "execute"))
    + ", round(count(*) FILTER (kind = 'delete') / CAST(nullif(count(*) FILTER (kind = 'write'), 0) AS DOUBLE), 6) AS delete_write_ratio, round(count(*) FILTER (kind = 'move') / CAST(nullif(count(*) FILTER (kind = 'write'), 0) AS DOUBLE), 6) AS move_write_ratio, count(DISTINCT target) FILTER (kind IN ('delete', 'move')) AS n_destroyed_targets FROM ev GROUP BY run_id",
)
def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ops.lifecycle(event_log(spark, sf)))


BINS = f""", bn AS (SELECT *, (ts - min(ts) OVER (PARTITION BY run_id)) // {DAY} AS bin FROM ev)
"""


@query(
    "o15_window_chains",
    EV
    + BINS
    + """, f AS (SELECT run_id, bin, bool_or(kind = 'read') AS r, bool_or(kind = 'write') AS w, bool_or(kind IN ('delete', 'move')) AS x FROM bn GROUP BY ALL)
SELECT run_id, count(*) AS win_active, count(*) FILTER (r AND w AND x) AS win_chain, count(*) FILTER (w AND NOT r AND NOT x) AS win_write_only, count(*) FILTER (NOT (r AND w AND x) AND NOT (w AND NOT r AND NOT x)) AS win_other FROM f GROUP BY run_id""",
)
def window_chains(spark: SparkSession, sf: str) -> DataFrame:
    return ops.window_chains(event_log(spark, sf), DAY)


@query(
    "o16_window_correlation",
    EV
    + f""", e AS (SELECT run_id, (ts - min(ts) OVER (PARTITION BY run_id)) // {7 * DAY} AS bin, CAST(kind = 'write' AS INT) AS a, CAST(kind = 'delete' AS INT) AS b FROM ev WHERE kind IN ('write', 'delete')),
p AS (SELECT run_id, bin, sum(a) AS a, sum(b) AS b FROM e GROUP BY ALL),
gr AS (SELECT run_id, unnest(range(0, CAST(max(bin) + 1 AS BIGINT))) AS bin FROM p GROUP BY run_id),
d AS (SELECT run_id, bin, CAST(coalesce(a, 0) AS DOUBLE) AS a, CAST(coalesce(b, 0) AS DOUBLE) AS b FROM gr LEFT JOIN p USING (run_id, bin)),
s AS (SELECT run_id, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab FROM d GROUP BY run_id)
SELECT run_id, round((n * sab - sa * sb) / nullif(sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)), 0), 6) AS window_correlation FROM s""",
)
def window_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ops.window_correlation(event_log(spark, sf), F.col("kind") == "write", F.col("kind") == "delete", 7 * DAY))


@query(
    "p19_entropy",
    EV + ", c AS (SELECT run_id, target, count(*) AS c FROM ev GROUP BY ALL), t AS (SELECT run_id, sum(c) AS t FROM c GROUP BY run_id) SELECT run_id, round(-sum(c / CAST(t AS DOUBLE) * log2(c / CAST(t AS DOUBLE))), 6) AS entropy_bits FROM c JOIN t USING (run_id) GROUP BY run_id",
)
def target_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ops.call_entropy(event_log(spark, sf), "target"))


@query(
    "o20_preparation",
    EV
    + """, d AS (SELECT run_id, min(ts) FILTER (kind IN ('write', 'delete', 'move')) AS first_touch, min(ts) FILTER (kind = 'delete') AS d0, max(ts) FILTER (kind = 'delete') AS d1 FROM ev GROUP BY run_id),
p AS (SELECT run_id, ts FROM ev WHERE kind = 'move')
SELECT d.run_id, count(p.ts) AS n_prep, round((first_touch - min(p.ts)) / 1000000.0, 3) AS prep_to_touch_s, round((d0 - min(p.ts)) / 1000000.0, 3) AS prep_to_destroy_s,
 CASE WHEN d0 IS NOT NULL AND count(p.ts) > 0 THEN count(*) FILTER (p.ts < d0) END AS prep_before, CASE WHEN d0 IS NOT NULL AND count(p.ts) > 0 THEN count(*) FILTER (p.ts BETWEEN d0 AND d1) END AS prep_during, CASE WHEN d0 IS NOT NULL AND count(p.ts) > 0 THEN count(*) FILTER (p.ts > d1) END AS prep_after,
 CASE WHEN d0 IS NOT NULL AND count(p.ts) > 0 THEN CAST(min(p.ts) <= d1 AS INT) END AS prep_overlaps_destroy, round(CASE WHEN d1 > d0 THEN (min(p.ts) - d0) / CAST(d1 - d0 AS DOUBLE) END, 3) AS prep_position
FROM d LEFT JOIN p USING (run_id) GROUP BY d.run_id, first_touch, d0, d1""",
)
def preparation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(seq.preparation(event_log(spark, sf), F.col("kind") == "move"), 3)


@query(
    "o21_behaviour_sequence",
    EV
    + """, f AS (SELECT run_id, kind AS token, min(pos) AS pos, min_by(ts, pos) AS ts FROM ev GROUP BY ALL)
SELECT run_id, string_agg(token, '>' ORDER BY ts, pos) AS sequence, count(*) AS n_tokens FROM f GROUP BY run_id""",
)
def behaviour_sequence(spark: SparkSession, sf: str) -> DataFrame:
    found = seq.sequences(event_log(spark, sf).withColumn("token", F.col("kind")))
    return found.select("run_id", F.array_join("sequence", ">").alias("sequence"), F.size("sequence").cast("long").alias("n_tokens"))


@query(
    "o22_encryption_onset",
    EV
    + """, s AS (SELECT *, coalesce(bool_or(kind = 'read') OVER (PARTITION BY run_id, target ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM ev)
SELECT run_id, count(*) AS n_rewrites, min_by(ts, pos) AS onset FROM s WHERE kind = 'write' AND seen GROUP BY run_id HAVING count(*) >= 8""",
)
def encryption_onset(spark: SparkSession, sf: str) -> DataFrame:
    return seq.rewrite_onset(event_log(spark, sf), [F.col("target")], least=8).drop("pos")


@query(
    "o23_note_onset",
    EV
    + """, n AS (SELECT run_id, category, count(DISTINCT target) AS dirs, min_by(ts, pos) AS onset FROM ev GROUP BY ALL HAVING count(DISTINCT target) >= 5)
SELECT run_id, max(dirs) AS widest, count(*) AS names, min(onset) AS onset FROM n GROUP BY run_id""",
)
def note_onset(spark: SparkSession, sf: str) -> DataFrame:
    return seq.spread_onset(event_log(spark, sf), F.col("category"), F.col("target"), least=5)


@query("o24_coarse_encryption", EV + "SELECT run_id, CAST(count(*) FILTER (kind = 'write') >= 12 AS INT) AS coarse_encryption FROM ev GROUP BY run_id")
def coarse_encryption(spark: SparkSession, sf: str) -> DataFrame:
    return behaviour.coarse_encryption(event_log(spark, sf), F.col("kind") == "write", least=12)


@query(
    "o25_decoy_damage",
    EV
    + FLAGS
    + """, y AS (SELECT *, (x AND NOT (w AND NOT r)) OR (w AND r) AS destroyed, w AND NOT r AS own FROM f)
SELECT run_id, count(*) FILTER (destroyed) AS destroyed_decoys, count(*) FILTER (own) AS self_created, count(*) FILTER (r AND NOT destroyed) AS read_only_decoys FROM y GROUP BY run_id""",
)
def decoy_damage(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.verdict import decoy_damage as damage

    return damage(event_log(spark, sf))


@query(
    "o29_execution_check",
    EV
    + "SELECT run_id, count(*) AS total_calls, count(*) FILTER (kind IN ('delete', 'move')) AS destructive_events, count(*) >= 60 AS executed, count(*) >= 50 AS covered FROM ev GROUP BY run_id",
)
def execution_check(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.verdict import execution

    return execution(event_log(spark, sf), executed=60, covered=50)


@query(
    "o30_verdict",
    EV
    + FLAGS
    + """, y AS (SELECT run_id, count(*) FILTER ((x AND NOT (w AND NOT r)) OR (w AND r)) AS destroyed FROM f GROUP BY run_id),
e AS (SELECT run_id, count(*) AS n, count(*) FILTER (kind = 'move') AS appends, count(DISTINCT api) FILTER (kind = 'move') / CAST(nullif(count(*) FILTER (kind = 'move'), 0) AS DOUBLE) AS div, count(*) FILTER (kind IN ('delete', 'move')) AS hits FROM ev GROUP BY run_id)
SELECT run_id, CASE WHEN destroyed >= 6 THEN 'TRUE_ENCRYPTION' WHEN appends >= 14 AND coalesce(div, 0) <= 0.35 THEN 'TRUE_ENCRYPTION' WHEN hits >= 28 THEN 'TRUE_ENCRYPTION' WHEN CAST(destroyed >= 5 AS INT) + CAST(appends >= 5 AS INT) + CAST(hits >= 5 AS INT) >= 3 THEN 'TRUE_ENCRYPTION'
 WHEN n < 60 THEN 'FAILED' WHEN destroyed > 0 THEN 'WEAK_VICTIM_ACTIVITY' ELSE 'NO_VICTIM_ACTIVITY' END AS verdict
FROM y JOIN e USING (run_id)""",
)
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    """The cascade alone, with limits that fit these runs; destructive events stand for renames to a shared extension."""
    from tidemark.operators import verdict as v

    log = event_log(spark, sf)
    moves = F.col("kind") == "move"
    counts = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_calls"), F.count_if(moves).alias("append_renames"), F.count_distinct(F.when(moves, F.col("api"))).alias("distinct_suffixes"), F.count_if(F.col("kind").isin("delete", "move")).alias("shared_extension_renames"))
    evidence = counts.join(v.decoy_damage(log), "run_id").withColumns({"note_dirs": F.lit(0), "note_explicit": F.lit(False)})
    limits = v.Limits(destroyed=6, appends=14, diversity=0.35, shared=28, axes=3, events_an_axis=5, executed=60)
    return v.verdicts(evidence, limits).select("run_id", "verdict")


@query(
    "o35_has_and_order",
    EV
    + """, f AS (SELECT run_id, min(pos) FILTER (kind = 'read') AS rd, min(pos) FILTER (kind = 'write') AS wr, min(pos) FILTER (kind = 'delete') AS de, min(pos) FILTER (kind = 'execute') AS ex FROM ev GROUP BY run_id)
SELECT run_id, CAST(rd IS NOT NULL AS INT) AS has_read, CAST(wr IS NOT NULL AS INT) AS has_write, CAST(de IS NOT NULL AS INT) AS has_delete, CAST(ex IS NOT NULL AS INT) AS has_execute, """
    + ", ".join(f"CAST({a[:2] if a != 'write' else 'wr'} < {b[:2] if b != 'write' else 'wr'} AS INT) AS ord_{a}_{b}".replace("re <", "rd <").replace("< re ", "< rd ") for a, b in [("read", "write"), ("read", "delete"), ("read", "execute"), ("write", "delete"), ("write", "execute"), ("delete", "execute")])
    + " FROM f",
)
def has_and_order(spark: SparkSession, sf: str) -> DataFrame:
    found = seq.sequences(event_log(spark, sf).withColumn("token", F.col("kind")))
    return seq.presence_and_order(found, ["read", "write", "delete", "execute"])


@query("w01_adjacent_pairs", EV + "SELECT run_id, pos, kind, lead(kind) OVER (PARTITION BY run_id ORDER BY pos) AS next_kind FROM ev")
def adjacent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("run_id").orderBy("pos")
    return event_log(spark, sf).select("run_id", "pos", "kind", F.lead("kind").over(by).alias("next_kind"))


@query(
    "w02_islands",
    EV
    + """, c AS (SELECT run_id, pos, kind, CAST(coalesce(lag(kind) OVER (PARTITION BY run_id ORDER BY pos) <> kind, true) AS INT) AS ch FROM ev), i AS (SELECT *, sum(ch) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT run_id, CAST(island AS BIGINT) AS island, min(kind) AS kind, min(pos) AS first_pos, count(*) AS length FROM i GROUP BY run_id, island""",
)
def islands(spark: SparkSession, sf: str) -> DataFrame:
    return seq.islands(event_log(spark, sf), F.col("kind")).select("run_id", "island", F.col("value").alias("kind"), "first_pos", "length")


@query(
    "w03_collapsed_kinds",
    EV + ", c AS (SELECT run_id, target, pos, kind, lag(kind) OVER (PARTITION BY run_id, target ORDER BY pos) AS before FROM ev) SELECT run_id, target, pos, kind FROM c WHERE before IS NULL OR before <> kind",
)
def collapsed_kinds(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("run_id", "target").orderBy("pos")
    return event_log(spark, sf).withColumn("before", F.lag("kind").over(by)).filter("before is null or before <> kind").select("run_id", "target", "pos", "kind")


@query("w04_first_occurrence", EV + "SELECT run_id, kind, min(pos) AS pos, min_by(ts, pos) AS ts FROM ev GROUP BY run_id, kind")
def first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).groupBy("run_id", "kind").agg(F.min("pos").alias("pos"), F.min_by("ts", "pos").alias("ts"))


@query("w06_run_windows", EV + BINS + "SELECT run_id, bin, count(*) AS n, count(DISTINCT kind) AS kinds FROM bn GROUP BY run_id, bin")
def run_windows(spark: SparkSession, sf: str) -> DataFrame:
    anchored = event_log(spark, sf).withColumn("bin", F.floor((F.col("ts") - F.min("ts").over(Window.partitionBy("run_id"))) / DAY))
    return anchored.groupBy("run_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("kinds"))


@query("w07_seen_targets", EV + "SELECT run_id, pos, coalesce(bool_or(kind = 'read') OVER (PARTITION BY run_id, target ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM ev")
def seen_targets(spark: SparkSession, sf: str) -> DataFrame:
    return seq.seen_before(event_log(spark, sf), F.col("target"), F.col("kind") == "read").select("run_id", "pos", "seen")
