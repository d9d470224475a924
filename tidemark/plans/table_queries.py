"""Queries of joins, aggregates, statistics, splits and manifest operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import paths, safe
from tidemark.operators import decisions
from tidemark.operators import sequences as seq
from tidemark.operators import stats
from tidemark.operators.ranks import bucket_of_hash, numbered
from tidemark.operators import tables as ops
from tidemark.plans.event_queries import _rounded
from tidemark.plans.registry import query
from tidemark.sources.testdata import EVENT_LOG_SQL as EV
from tidemark.sources.testdata import event_log, table

DAY = 86_400_000_000


def _count(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


# -- joins


@query("j01_attach_last", "SELECT c_custkey, p AS last_price, p IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max_by(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) USING (c_custkey)")
def attach_last(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("last_price"))
    return ops.attach(table(spark, sf, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey").select("c_custkey", "last_price", "matched")


@query("j02_attach_behaviour", EV + ", s AS (SELECT run_id, count(DISTINCT kind) AS n_kinds FROM ev GROUP BY run_id) SELECT c_custkey, n_kinds, n_kinds IS NOT NULL AS matched FROM customer LEFT JOIN s ON run_id = c_custkey")
def attach_behaviour(spark: SparkSession, sf: str) -> DataFrame:
    kinds = event_log(spark, sf).groupBy(F.col("run_id").alias("c_custkey")).agg(F.count_distinct("kind").alias("n_kinds"))
    return ops.attach(table(spark, sf, "customer").select("c_custkey"), kinds, "c_custkey").select("c_custkey", "n_kinds", "matched")


@query("j03_verdict_attach", "SELECT d.doc_id, toxic, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def verdict_attach(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "toxic", "quality")


@query("j04_filtered_inner", "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND o_totalprice IS NOT NULL")
def filtered_inner(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_totalprice IS NOT NULL")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select("o_orderkey", "c_mktsegment", "o_totalprice")


@query("j05_family_lookup", "SELECT c_custkey, n_name AS family FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def family_lookup(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("family"))  # 25 rows by definition
    return table(spark, sf, "customer").join(F.broadcast(nations), "c_nationkey", "left").select("c_custkey", "family")


@query("j06_fallback_lookup", "SELECT o_orderkey, coalesce(a.v, b.v, c.v) AS v FROM orders LEFT JOIN (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_acctbal > 8000) a ON o_custkey = a.k LEFT JOIN (SELECT s_suppkey // 2 AS k, min(s_name) AS v FROM supplier GROUP BY k) b ON o_custkey = b.k LEFT JOIN (SELECT p_partkey AS k, p_name AS v FROM part) c ON o_orderkey = c.k")
def fallback_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("supp"))
    a = table(spark, sf, "customer").filter("c_acctbal > 8000").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    b = table(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / 2).alias("k"), F.col("s_name").alias("v"))  # twice each
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    return ops.first_of(rows, [a, b, c], ["o_custkey", "supp", "o_orderkey"], "v").select("o_orderkey", "v")


@query("j07_override_union", "SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS rn FROM (SELECT c_custkey AS k, c_name AS v, 0 AS t FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier)) WHERE rn = 1")
def override_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return ops.override(a, b, "k")


@query("j08_label_crosstab", "SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return both.groupBy("lang").pivot("quality", [0, 1]).count().select("lang", F.coalesce("0", F.lit(0)).alias("q0"), F.coalesce("1", F.lit(0)).alias("q1"))


@query("j09_near_in_time", EV + "SELECT a.event_id AS event_id, b.event_id AS error_id, a.ts - b.ts AS gap FROM ev a JOIN ev b ON a.ts BETWEEN b.ts - 90000000 AND b.ts + 90000000 WHERE a.category <> 'error' AND b.category = 'error'")
def near_in_time(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    errors = log.filter("category = 'error'").select(F.col("event_id").alias("error_id"), "ts")
    return ops.near_in_time(log.filter("category <> 'error'").select("event_id", "ts"), errors, 90_000_000).select("event_id", "error_id", (F.col("ts") - F.col("other_ts")).alias("gap"))


@query("j10_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(held, "c_custkey", "left_semi")


@query("j11_extended_names", "WITH n AS (SELECT c_nationkey AS dir, CAST(c_custkey AS VARCHAR) AS name FROM customer) SELECT a.dir, a.name, min(b.name) AS original FROM n a JOIN n b ON a.dir = b.dir AND starts_with(a.name, b.name) AND a.name <> b.name GROUP BY a.dir, a.name")
def extended_names(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_nationkey").alias("dir"), F.col("c_custkey").cast("string").alias("name"))
    return ops.extended_names(names, "dir", "name").select("dir", "name", "original")


@query("j13_latest_mapping", EV + "SELECT run_id, pos, last_value(CASE WHEN kind = 'read' THEN api END IGNORE NULLS) OVER (PARTITION BY run_id, target ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mapped FROM ev")
def latest_mapping(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("run_id", "target").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return event_log(spark, sf).select("run_id", "pos", F.last(F.when(F.col("kind") == "read", F.col("api")), ignorenulls=True).over(by).alias("mapped"))


@query("j14_tree_closure", "WITH RECURSIVE e AS (SELECT c_nationkey AS run_id, c_custkey AS node, c_custkey // 2 AS parent, c_custkey % 7 = 3 AS bad FROM customer), t AS (SELECT 0 AS run_id, node FROM e WHERE node = 1 AND NOT bad UNION SELECT 0, e.node FROM e JOIN t ON e.parent = t.node WHERE NOT e.bad AND e.node <> e.parent) SELECT CAST(run_id AS INT) AS run_id, node FROM t")
def tree_closure(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "customer").select(F.lit(0).alias("run_id"), F.col("c_custkey").alias("node"), F.floor(F.col("c_custkey") / 2).alias("parent"), (F.col("c_custkey") % 7 == 3).alias("bad"))
    return ops.tree_closure(edges, F.col("node") == 1, F.col("bad"))


@query("j15_intent_lookup", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast' WHEN '5-LOW' THEN 'slow' ELSE 'unclassified' END AS intent FROM orders")
def intent_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("1-URGENT", "fast"), ("2-HIGH", "fast"), ("5-LOW", "slow")], "o_orderpriority string, intent string")
    return table(spark, sf, "orders").join(F.broadcast(names), "o_orderpriority", "left").select("o_orderkey", F.coalesce("intent", F.lit("unclassified")).alias("intent"))


@query("j16_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return ops.unseen(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("j17_scores_by_class", "SELECT lang, count(*) AS n, round(avg(CASE WHEN n_chars >= 2000 THEN 1.0 ELSE 0.0 END), 6) AS flagged, round(avg(CAST(n_chars AS DOUBLE)), 6) AS mean_score FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def scores_by_class(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return _rounded(both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("n_chars") >= 2000).cast("double")).alias("flagged"), F.avg(F.col("n_chars").cast("double")).alias("mean_score")))


# -- aggregates


@query("a01_group_count", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("a02_conditional_count", "SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS high, count(*) FILTER (l_quantity < 10) AS small FROM lineitem GROUP BY 1")
def conditional_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("high"), F.count_if(F.col("l_quantity") < 10).alias("small"))


@query("a03_distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def distinct_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("a04_top_share", "SELECT l_returnflag, round(max(c) / CAST(sum(c) AS DOUBLE), 6) AS top_share FROM (SELECT l_returnflag, l_quantity, count(*) AS c FROM lineitem GROUP BY ALL) GROUP BY 1")
def top_share(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("c"))
    return _rounded(counts.groupBy("l_returnflag").agg(safe.ratio(F.max("c"), F.sum("c")).alias("top_share")))


@query("a05_upper_median", "SELECT l_suppkey, l[len(l) // 2 + 1] AS mid FROM (SELECT l_suppkey, list_sort(list(l_quantity)) AS l FROM lineitem GROUP BY 1)")
def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(safe.upper_median("l_quantity").alias("mid"))


@query("a06_variation", "SELECT l_suppkey, round(stddev_pop(l_quantity), 6) AS sd, round(stddev_pop(l_quantity) / nullif(avg(l_quantity), 0), 6) AS cv FROM lineitem GROUP BY 1")
def variation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.stddev_pop("l_quantity").alias("sd"), safe.variation(F.col("l_quantity")).alias("cv")))


@query("a07_pearson", "SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0), 6) AS r, CAST(NULL AS DOUBLE) AS constant FROM lineitem GROUP BY 1")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(safe.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("r"), safe.pearson(F.col("l_quantity"), F.lit(1.0)).alias("constant")))


@query("a08_entropy", "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS c FROM orders GROUP BY ALL), t AS (SELECT o_orderstatus, sum(c) AS t FROM c GROUP BY 1) SELECT o_orderstatus, round(-sum(c / CAST(t AS DOUBLE) * log2(c / CAST(t AS DOUBLE))), 6) AS bits FROM c JOIN t USING (o_orderstatus) GROUP BY 1")
def entropy(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("c"))
    t = c.groupBy("o_orderstatus").agg(F.sum("c").alias("t"))
    return _rounded(c.join(t, "o_orderstatus").groupBy("o_orderstatus").agg(safe.entropy(F.col("c"), F.col("t")).alias("bits")))


@query("a09_span", EV + "SELECT run_id, min(ts) AS first_ts, max(ts) AS last_ts, (max(ts) - min(ts)) / 1000000.0::DOUBLE AS span_s FROM ev GROUP BY run_id")
def span(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).groupBy("run_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), ((F.max("ts") - F.min("ts")) / 1e6).alias("span_s"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("a10_crosstab", "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS p{p[0]}" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def crosstab(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", PRIORITIES).count()
    return wide.select("o_orderstatus", *[F.coalesce(f"`{p}`", F.lit(0)).alias(f"p{p[0]}") for p in PRIORITIES])


@query("a11_totals", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("a12_prevalence", "SELECT c_mktsegment, 'c_acctbal' AS feature, count(c_acctbal) AS n, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1")
def prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.prevalence(table(spark, sf, "customer"), ["c_acctbal"], "c_mktsegment"))


WILSON = "round({p}, 6) AS rate, round(greatest(0.0, ({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) - 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})), 6) AS low, round(least(1.0, ({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) + 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n})), 6) AS high"


@query("e01_rates", "SELECT l_shipmode AS level, n, hits, " + WILSON.format(p="(hits / CAST(n AS DOUBLE))", n="CAST(n AS DOUBLE)") + " FROM (SELECT l_linenumber AS l_shipmode, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem GROUP BY 1)")
def rates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.rates(table(spark, sf, "lineitem"), F.col("l_linenumber"), F.col("l_returnflag") == "R"))


@query("a13_wilson", "SELECT p_brand AS level, n, hits, " + WILSON.format(p="(hits / CAST(n AS DOUBLE))", n="CAST(n AS DOUBLE)") + " FROM (SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 25) AS hits FROM part GROUP BY 1) WHERE n >= 5")
def wilson(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.rates(table(spark, sf, "part"), F.col("p_brand"), F.col("p_size") > 25))


AUC = """SELECT feature, sum(y) AS n_pos, count(*) - sum(y) AS n_neg, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)), 0) AS auc
FROM (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM long) GROUP BY feature"""
LONG = "WITH base AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS n_chars, CAST(d.doc_id % 7 AS DOUBLE) AS slot FROM documents d JOIN labels l ON d.doc_id = l.doc_id), long AS (SELECT y, 'n_chars' AS feature, n_chars AS value FROM base UNION ALL SELECT y, 'slot', slot FROM base)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), (F.col("doc_id") % 7).cast("double").alias("slot"), "lang", "source")
    return docs.join(table(spark, sf, "labels").withColumn("y", F.col("quality")), "doc_id")


@query("a14_auc", LONG + f"SELECT feature, {_count('n_pos')} AS n_pos, {_count('n_neg')} AS n_neg, round(auc, 6) AS auc FROM ({AUC})")
def auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.auc(stats.unpivoted(_labelled(spark, sf), ["y"], ["n_chars", "slot"]), ["feature"]))


@query("e03_ranking", LONG + f", a AS ({AUC}), m AS (SELECT feature, list_sort(list(value) FILTER (y = 1)) AS p, list_sort(list(value) FILTER (y = 0)) AS q, count(value) AS n FROM long GROUP BY 1) SELECT feature, round(auc, 6) AS auc, round(n / CAST((SELECT count(*) FROM base) AS DOUBLE), 6) AS coverage, p[len(p) // 2 + 1] AS pos_median, q[len(q) // 2 + 1] AS neg_median, {_count('n_pos')} AS n_pos, {_count('n_neg')} AS n_neg FROM a JOIN m USING (feature)")
def ranking(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.ranking(_labelled(spark, sf), ["n_chars", "slot"]))


@query(
    "e04_banded_auc",
    LONG.replace("AS slot FROM", "AS slot, CAST(n_chars >= 1500 AS INT) + CAST(n_chars >= 4000 AS INT) AS b FROM").replace("SELECT y, 'n_chars' AS feature, n_chars AS value FROM base", "SELECT y, 'n_chars/' || b AS feature, n_chars AS value FROM base").replace("SELECT y, 'slot', slot FROM base", "SELECT y, 'slot/' || b, slot FROM base")
    + f", a AS ({AUC}) SELECT split_part(feature, '/', 1) AS feature, count(*) AS bands, round(min(abs(auc - 0.5)), 6) AS worst_distance, count(DISTINCT auc > 0.5) = 1 AS consistent FROM a WHERE auc IS NOT NULL GROUP BY 1",
)
def banded_auc(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf).withColumn("band", stats.band(F.col("n_chars"), [1500, 4000]))
    return _rounded(stats.worst_band(stats.ranking(rows, ["n_chars", "slot"], by=["band"])))


@query("e05_sources", LONG.replace("AS slot FROM", "AS slot, lang FROM").replace("'n_chars' AS feature, n_chars", "'n_chars/' || lang AS feature, n_chars").replace("'slot', slot", "'slot/' || lang, slot") + f" SELECT split_part(feature, '/', 2) AS lang, split_part(feature, '/', 1) AS feature, round(CASE WHEN n_pos >= 5 AND n_neg >= 5 THEN auc END, 6) AS auc, {_count('n_pos')} AS n_pos, {_count('n_neg')} AS n_neg FROM ({AUC})")
def sources(spark: SparkSession, sf: str) -> DataFrame:
    long = stats.unpivoted(_labelled(spark, sf), ["y", "lang"], ["n_chars", "slot"])
    return _rounded(stats.auc(long, ["lang", "feature"], 5)).select("lang", "feature", "auc", "n_pos", "n_neg")


@query("a15_coverage", "SELECT count(DISTINCT d.doc_id) AS docs, round(count(quality) / CAST(count(*) AS DOUBLE), 6) AS share FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return _rounded(both.agg(F.count_distinct("doc_id").alias("docs"), safe.ratio(F.count("quality"), F.count(F.lit(1))).alias("share")))


@query("a16_spread_per_name", EV + "SELECT api, count(DISTINCT run_id) AS runs FROM ev GROUP BY api HAVING count(DISTINCT run_id) >= 5")
def spread_per_name(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).groupBy("api").agg(F.count_distinct("run_id").alias("runs")).filter("runs >= 5")


@query("a17_evidence_combination", "SELECT evidence, count(*) AS n FROM (SELECT concat_ws(' + ', CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_quantity > 25 THEN 'volume' END, CASE WHEN l_returnflag = 'R' THEN 'return' END) AS evidence FROM lineitem) GROUP BY 1")
def evidence_combination(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.when(F.col("l_discount") > 0.05, "discount"), F.when(F.col("l_quantity") > 25, "volume"), F.when(F.col("l_returnflag") == "R", "return")]
    return table(spark, sf, "lineitem").groupBy(F.concat_ws(" + ", *parts).alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


@query("a18_class_summary", "WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), g AS (SELECT l_returnflag, min(x) AS low, max(x) FILTER (i = n // 2) AS mid, max(x) AS high FROM r GROUP BY l_returnflag) SELECT *, (mid + lag(mid) OVER (ORDER BY mid)) / 2 AS separation FROM g")
def class_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.class_summary(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query("a19_best_of", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END DESC, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def best_of(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return ops.best_of(table(spark, sf, "orders"), F.col("o_custkey").cast("string"), [rank.desc(), F.desc("o_totalprice")], "o_orderkey").select("o_custkey", "o_orderkey")


@query("e02_matched_cells", "WITH c AS (SELECT l_linenumber, l_linestatus, count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'R') AS nb, count(*) FILTER (l_returnflag = 'A' AND l_discount > 0.05) AS ha, count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.05) AS hb FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL HAVING na > 0 AND nb > 0), s AS (SELECT count(*) AS cells, CAST(sum(na) AS BIGINT) AS na, CAST(sum(nb) AS BIGINT) AS nb, sum(ha) / CAST(sum(na) AS DOUBLE) AS pa, sum(hb) / CAST(sum(nb) AS DOUBLE) AS pb FROM c), w AS (SELECT *, (pa + 3.8416 / (2 * na)) / (1 + 3.8416 / na) AS ca, 1.96 * sqrt(pa * (1 - pa) / na + 3.8416 / (4.0 * na * na)) / (1 + 3.8416 / na) AS da, (pb + 3.8416 / (2 * nb)) / (1 + 3.8416 / nb) AS cb, 1.96 * sqrt(pb * (1 - pb) / nb + 3.8416 / (4.0 * nb * nb)) / (1 + 3.8416 / nb) AS db FROM s) SELECT cells, na, nb, round(pa, 6) AS rate_a, round(ca - da, 6) AS low_a, round(ca + da, 6) AS high_a, round(pb, 6) AS rate_b, round(cb - db, 6) AS low_b, round(cb + db, 6) AS high_b, ca - da <= cb + db AND cb - db <= ca + da AS overlap FROM w")
def matched_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.matched_cells(table(spark, sf, "lineitem"), F.col("l_returnflag"), "A", "R", ["l_linenumber", "l_linestatus"], F.col("l_discount") > 0.05))


@query("e06_preparation_bands", EV + ", r AS (SELECT run_id, count(*) AS n, count(*) FILTER (kind = 'execute') AS prep FROM ev GROUP BY run_id) SELECT CAST(CAST(n >= 60 AS INT) + CAST(n >= 70 AS INT) AS INT) AS band, count(*) AS runs, round(avg(CASE WHEN prep > 10 THEN 1.0 ELSE 0.0 END), 6) AS share FROM r GROUP BY 1 HAVING count(*) >= 5")
def preparation_bands(spark: SparkSession, sf: str) -> DataFrame:
    per = event_log(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "execute").alias("prep"))
    return _rounded(per.groupBy(stats.band(F.col("n"), [60, 70]).alias("band")).agg(F.count(F.lit(1)).alias("runs"), F.avg((F.col("prep") > 10).cast("double")).alias("share")).filter("runs >= 5"))


#: Per run: what preparing (execute) has to do with destroying (delete or move), and how long the run took, in seconds.
PREPARED = EV + """, p AS (SELECT run_id, min(ts) FILTER (kind = 'execute') AS p0, min(ts) FILTER (kind IN ('delete', 'move')) AS d0, max(ts) AS t1, min(ts) AS t0, count(*) FILTER (kind = 'execute') AS n_prep, count(*) FILTER (kind = 'delete') AS n_delete, count(*) AS n FROM ev WHERE pos <= 8 GROUP BY run_id),
t AS (SELECT run_id, run_id % 3 = 0 AS reached, n_prep, n_delete, (d0 - p0) / 1e6 AS gap_s, (t1 - t0) / 1e6 AS span_s, CASE WHEN p0 IS NOT NULL AND d0 IS NOT NULL THEN CAST(p0 <= d0 AS INT) END AS precedes FROM p)
"""


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    log, at = event_log(spark, sf).filter("pos <= 8"), lambda c: F.min(F.when(c, F.col("ts")))
    prep, destroy = F.col("kind") == "execute", F.col("kind").isin("delete", "move")
    per = log.groupBy("run_id").agg(at(prep).alias("p0"), at(destroy).alias("d0"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count_if(prep).alias("n_prep"), F.count_if(F.col("kind") == "delete").alias("n_delete"))
    return per.select("run_id", (F.col("run_id") % 3 == 0).alias("reached"), "n_prep", "n_delete", ((F.col("d0") - F.col("p0")) / 1e6).alias("gap_s"), ((F.col("t1") - F.col("t0")) / 1e6).alias("span_s"), (F.col("p0") <= F.col("d0")).cast("int").alias("precedes"))


@query(
    "e06_whole_set",
    PREPARED + """, u AS (SELECT reached, unnest(['n_prep', 'n_delete', 'precedes']) AS feature, unnest([n_prep, n_delete, precedes]) AS v FROM t)
SELECT feature, round(avg(CASE WHEN v > 0 THEN 100.0 ELSE 0 END) FILTER (reached AND v IS NOT NULL), 6) AS reached, round(avg(CASE WHEN v > 0 THEN 100.0 ELSE 0 END) FILTER (NOT reached AND v IS NOT NULL), 6) AS others,
 round(avg(CASE WHEN v > 0 THEN 100.0 ELSE 0 END) FILTER (reached AND v IS NOT NULL) - avg(CASE WHEN v > 0 THEN 100.0 ELSE 0 END) FILTER (NOT reached AND v IS NOT NULL), 6) AS gap FROM u GROUP BY feature""",
)
def preparation_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that reached the end against the others, activity not held constant."""
    return _rounded(stats.prevalence_gap(_prepared(spark, sf), ["n_prep", "n_delete", "precedes"], F.col("reached")))


@query(
    "e06_timing",
    PREPARED + """, u AS (SELECT unnest(['gap_s', 'span_s', 'precedes']) AS feature, unnest([gap_s, span_s, precedes]) AS v FROM t WHERE reached)
SELECT feature, count(v) AS n, round(min(v), 6) AS least, round(median(v), 6) AS median, round(max(v), 6) AS most FROM u WHERE v IS NOT NULL GROUP BY feature""",
)
def preparation_timing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How long before destruction preparation came, among runs that reached the end."""
    return _rounded(stats.timing_summary(_prepared(spark, sf).filter("reached"), ["gap_s", "span_s", "precedes"]))


@query("a19_disagreements", "WITH k AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS s FROM orders WHERE o_custkey % 10 > 0 GROUP BY o_custkey) SELECT count(*) FILTER (n > 1) AS repeated, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS removed, count(*) FILTER (n > 1 AND s > 1) AS disagreed FROM k")
def disagreements(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey").cast("string")).otherwise(" ")
    return ops.disagreements(table(spark, sf, "orders"), key, F.col("o_orderstatus"))


@query("e08_label_check", "WITH d AS (SELECT CASE doc_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'A2' WHEN 2 THEN 'F' ELSE 'N' END AS label, n_chars >= 1000 AS hit FROM documents) SELECT count(*) FILTER (label IN ('A', 'A2')) AS confirmed, count(*) FILTER (label IN ('A', 'A2') AND hit) AS detected, count(*) FILTER (label IN ('A', 'A2') AND NOT hit) AS missed, count(*) FILTER (label = 'N') AS negatives, count(*) FILTER (label = 'N' AND hit) AS flagged, count(*) FILTER (label IN ('A', 'A2') AND NOT hit) = 0 AND count(*) FILTER (label = 'N' AND hit) = 0 AS passes FROM d")
def label_check(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in ("A", "A2", "F", "N", "N")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return decisions.label_check(table(spark, sf, "documents").withColumn("label", label), "label", F.col("n_chars") >= 1000)


@query("e09_agreement", "SELECT agreement, count(*) AS n FROM (SELECT CASE WHEN v = '' OR c = 'unknown' THEN '' WHEN (v = 'TRUE_ENCRYPTION') = (c = 'yes') THEN 'agree' WHEN c = 'yes' THEN 'REVIEW: screen changed but verdict says no encryption' ELSE 'REVIEW: verdict says encryption but screen unchanged' END AS agreement FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'TRUE_ENCRYPTION' WHEN 'O' THEN 'FAILED' ELSE '' END AS v, CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS c FROM orders)) GROUP BY 1")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("o_orderstatus") == "F", "TRUE_ENCRYPTION").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("")
    change = F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("unknown")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf, "orders").groupBy(decisions.agreement_class(verdict, change).alias("agreement")).agg(F.count(F.lit(1)).alias("n"))


@query("e10_failure_intents", "SELECT intent, count(*) AS n, count(*) FILTER (rate >= 0.5) AS flagged FROM (SELECT CASE WHEN p_partkey % 7 = 6 THEN 'unclassified' ELSE (['destroys', 'ambiguous', 'invisible', 'harmless', 'unclassified'])[p_partkey % 5 + 1] END AS intent, p_size / 50.0 AS rate FROM part) GROUP BY intent")
def failure_intents(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by name of their variant, its intent, and how many are flagged."""
    part = table(spark, sf, "part")
    variant = F.element_at(F.array(*[F.lit(x) for x in ['m2_copydel', 'stage2', 'tool_cipher', 'm5_drop', 'zz']]), (F.col("p_partkey") % 5 + 1).cast("int"))
    map_ = part.filter("p_partkey % 7 <> 6").select(F.col("p_partkey").alias("task_id"), F.concat(variant, F.lit(".exe")).alias("variant"))
    rows = part.select(F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("sample_id"), (F.col("p_size") / 50.0).alias("rate"))
    return decisions.failures(decisions.intents(rows, map_), "rate", 0.5)


@query("e11_retry_decision", EV + ", r AS (SELECT run_id, count(*) AS n, count(*) FILTER (kind = 'execute') AS shots, ['truncated', 'sample_launch_failed', 'no_log', 'clean'][run_id % 4 + 1] AS outcome FROM ev GROUP BY run_id), d AS (SELECT *, CASE WHEN run_id % 9 = 0 THEN 'RETRY' WHEN n >= 70 THEN 'NO_RETRY' WHEN run_id % 5 = 0 THEN 'RETRY' WHEN outcome = 'sample_launch_failed' THEN 'NO_RETRY' WHEN outcome IN ('no_log', 'truncated') THEN 'RETRY' ELSE 'NO_RETRY' END AS decision FROM r) SELECT run_id, decision, decision = CASE WHEN shots = 0 THEN 'RETRY' ELSE 'NO_RETRY' END AS signals_agree FROM d")
def retry_decision(spark: SparkSession, sf: str) -> DataFrame:
    r = event_log(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "execute").alias("shots"))
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("truncated", "sample_launch_failed", "no_log", "clean")]), (F.col("run_id") % 4 + 1).cast("int"))
    decision, _ = decisions.retry_decision(outcome, F.col("run_id") % 5 == 0, F.col("n"), F.col("run_id") % 9 == 0, usable=70)
    return r.select("run_id", decision.alias("decision"), (decision == decisions.screenshot_decision(F.col("shots"))).alias("signals_agree"))


@query("e07_kill_effect", EV + ", r AS (SELECT run_id, 'fam' || (run_id % 3) AS family, count(*) FILTER (kind = 'delete') AS kills, count(*) >= 55 AS covered, count(*) FILTER (kind = 'move') >= 14 AS pos FROM ev GROUP BY run_id), p AS (SELECT family, count(*) AS runs, count(*) FILTER (pos) AS positive, count(*) FILTER (kills > 12) AS with_feature, count(*) FILTER (kills > 12 AND pos) AS with_feature_positive, count(*) FILTER (kills > 12 AND run_id % 2 = 0) AS cut_short, count(*) FILTER (kills > 12 AND run_id % 5 = 0) AS whole_window FROM r WHERE covered GROUP BY family) SELECT *, round(positive / CAST(runs AS DOUBLE), 6) AS rate, round(with_feature_positive / CAST(nullif(with_feature, 0) AS DOUBLE), 6) AS rate_with_feature, round(with_feature / CAST(nullif(sum(with_feature) OVER (), 0) AS DOUBLE), 6) AS share FROM p")
def kill_effect(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("kind")
    r = event_log(spark, sf).groupBy("run_id").agg(F.greatest(F.count_if(kind == "delete") - 12, F.lit(0)).alias("kills"), F.when(F.count(F.lit(1)) >= 55, "full").alias("coverage"), F.when(F.count_if(kind == "move") >= 14, "TRUE_ENCRYPTION").otherwise("FAILED").alias("verdict"))
    facts = r.withColumns({"family": F.concat(F.lit("fam"), F.col("run_id") % 3), "agent_died": F.col("run_id") % 2 == 0, "hit_timeout": F.col("run_id") % 5 == 0})
    return _rounded(decisions.kill_effect(facts, "kills"))


@query("e18_precision_at_base_rate", "SELECT p_brand, round(hit * 0.01 / nullif(hit * 0.01 + fp * 0.99, 0), 6) AS precision_1pct FROM (SELECT p_brand, avg(CASE WHEN p_size > 10 THEN 1.0 ELSE 0.0 END) AS hit, avg(CASE WHEN p_size > 40 THEN 1.0 ELSE 0.0 END) AS fp FROM part GROUP BY 1)")
def precision_at_base_rate(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") > 10).cast("double")).alias("hit"), F.avg((F.col("p_size") > 40).cast("double")).alias("fp"))
    return _rounded(per.select("p_brand", stats.precision_at(F.col("hit"), F.col("fp"), 0.01).alias("precision_1pct")))


@query("e19_empty_columns", "SELECT column_name, n FROM (SELECT 'n_chars' AS column_name, count(n_chars) AS n FROM documents UNION ALL SELECT 'text', count(text) FROM documents UNION ALL SELECT 'nothing', 0) WHERE n = 0")
def empty_columns(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("nothing", F.lit(None).cast("string"))
    counts = docs.agg(*[F.count(c).alias(c) for c in ("n_chars", "text", "nothing")])
    return counts.unpivot([], ["n_chars", "text", "nothing"], "column_name", "n").filter("n = 0")


@query("e20_fpr_by_volume", "SELECT CAST(CAST(n_chars >= 1000 AS INT) + CAST(n_chars >= 5000 AS INT) AS INT) AS band, count(*) AS n, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS fpr FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 GROUP BY 1")
def fpr_by_volume(spark: SparkSession, sf: str) -> DataFrame:
    clean = _labelled(spark, sf).filter("toxic = 0")
    return _rounded(clean.groupBy(stats.band(F.col("n_chars"), [1000, 5000]).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("doc_id") % 3 == 0).cast("double")).alias("fpr")))


@query("e21_cut_sweep", "SELECT c AS cut, round(avg(CASE WHEN quality = 1 THEN CASE WHEN n_chars >= c THEN 1.0 ELSE 0.0 END END), 6) AS tpr, round(avg(CASE WHEN quality = 0 THEN CASE WHEN n_chars >= c THEN 1.0 ELSE 0.0 END END), 6) AS fpr FROM documents JOIN labels USING (doc_id), (SELECT unnest([500.0::DOUBLE, 1500.0::DOUBLE, 4000.0::DOUBLE]) AS c) GROUP BY c")
def cut_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.cut_sweep(_labelled(spark, sf).withColumn("score", F.col("n_chars")), [500, 1500, 4000]))


@query("e22_pair_measurability", EV + ", f AS (SELECT run_id, run_id % 2 AS y, min(pos) FILTER (kind = 'read' AND target = 1) AS a, min(pos) FILTER (kind = 'write' AND target = 1) AS b FROM ev GROUP BY run_id) SELECT y, round(avg(CASE WHEN a < b OR a > b THEN 1.0 ELSE 0.0 END), 6) AS measurable FROM f GROUP BY y HAVING avg(CASE WHEN a < b OR a > b THEN 1.0 ELSE 0.0 END) >= 0.1")
def pair_measurability(spark: SparkSession, sf: str) -> DataFrame:
    marks = event_log(spark, sf).withColumn("token", F.when(F.col("target") == 1, F.col("kind")))
    order = seq.presence_and_order(seq.sequences(marks), ["read", "write"])
    runs = event_log(spark, sf).select("run_id").distinct().join(order, "run_id", "left")
    return _rounded(runs.groupBy((F.col("run_id") % 2).alias("y")).agg(F.avg(F.col("ord_read_write").isNotNull().cast("double")).alias("measurable")).filter("measurable >= 0.1"))


@query("e23_pareto", "WITH p AS (SELECT p_brand, avg(p_retailprice) AS cost, avg(CAST(p_size AS DOUBLE)) AS gain FROM part GROUP BY 1) SELECT p_brand FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.p_brand <> a.p_brand AND b.cost <= a.cost AND b.gain >= a.gain)")
def pareto(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("cost"), F.avg(F.col("p_size").cast("double")).alias("gain"))
    return stats.pareto(per, "cost", "gain").select("p_brand")


# -- sequences


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    """The sequence of each run, of all its events."""
    return seq.sequences(event_log(spark, sf).withColumn("token", F.col("kind")))


_PATTERNS = EV + """, f AS (SELECT run_id, kind AS token, min_by(ts, pos) AS ts, min(pos) AS pos FROM ev GROUP BY ALL), q AS (SELECT run_id, token, row_number() OVER (PARTITION BY run_id ORDER BY ts, pos) AS place FROM f),
pat AS (WITH RECURSIVE g AS (SELECT run_id, token AS pattern, place, 1 AS len FROM q UNION ALL SELECT g.run_id, g.pattern || '>' || q.token, q.place, len + 1 FROM g JOIN q ON g.run_id = q.run_id AND q.place > g.place WHERE len < 5) SELECT DISTINCT run_id, pattern, len FROM g),
t AS (SELECT count(*) AS n, count(*) FILTER (run_id % 2 = 1) AS np, count(*) FILTER (run_id % 2 = 0) AS nn FROM (SELECT DISTINCT run_id FROM q)),
c AS (SELECT pattern, len AS length, ph / CAST(np AS DOUBLE) AS pos_support, nh / CAST(nn AS DOUBLE) AS neg_support, ph / CAST(np AS DOUBLE) - nh / CAST(nn AS DOUBLE) AS contrast, ph AS pos_hits, nh AS neg_hits
 FROM (SELECT pattern, any_value(len) AS len, count(*) FILTER (run_id % 2 = 1) AS ph, count(*) FILTER (run_id % 2 = 0) AS nh FROM pat GROUP BY pattern HAVING count(*) FILTER (run_id % 2 = 1) >= 10), t)
"""


@query("g01_frequent_patterns", _PATTERNS + "SELECT pattern, support_count, round(support_count / CAST(n AS DOUBLE), 6) AS support FROM (SELECT pattern, count(*) AS support_count FROM pat GROUP BY pattern), t WHERE support_count >= greatest(2, floor(0.1 * n))")
def frequent_patterns(spark: SparkSession, sf: str) -> DataFrame:
    found = seq.frequent_patterns(_whole(spark, sf), 0.1)
    return _rounded(found.select(F.array_join("pattern", ">").alias("pattern"), F.col("support_count").cast("long").alias("support_count"), "support"))


@query("g02_pair_support", _PATTERNS + "SELECT pattern, count(*) AS support_count FROM pat WHERE len = 2 GROUP BY pattern HAVING count(*) >= 15")
def pair_support(spark: SparkSession, sf: str) -> DataFrame:
    return seq.frequent_patterns(_whole(spark, sf), 0.0, 2, least=15).filter("size(pattern) = 2").select(F.array_join("pattern", ">").alias("pattern"), F.col("support_count").cast("long").alias("support_count"))


def _contrast(spark: SparkSession, sf: str) -> DataFrame:
    found = _whole(spark, sf)
    pos, neg = found.filter("run_id % 2 = 1"), found.filter("run_id % 2 = 0")
    return seq.contrast(seq.frequent_patterns(pos, 0.0, least=10), pos, neg, 0.02)


@query("g03_contrast", _PATTERNS + "SELECT pattern, CAST(length AS BIGINT) AS length, round(pos_support, 6) AS pos_support, round(neg_support, 6) AS neg_support, round(contrast, 6) AS contrast, pos_hits, neg_hits FROM c WHERE contrast >= 0.02")
def contrast(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_contrast(spark, sf).withColumn("pattern", F.array_join("pattern", ">")))


@query("g04_pattern_matrix", _PATTERNS + ", top AS (SELECT pattern, row_number() OVER (ORDER BY round(contrast, 9) DESC, pattern) AS rn FROM c WHERE contrast >= 0.02) SELECT run_id, CAST(coalesce(bool_or(rn = 1), false) AS INT) AS seq_00, CAST(coalesce(bool_or(rn = 2), false) AS INT) AS seq_01, CAST(coalesce(bool_or(rn = 3), false) AS INT) AS seq_02 FROM pat LEFT JOIN (SELECT * FROM top WHERE rn <= 3) USING (pattern) GROUP BY run_id")
def pattern_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The three patterns with the highest contrast, as columns."""
    return seq.pattern_matrix(_whole(spark, sf), _contrast(spark, sf), 3)


@query("g05_token_frequency", EV + "SELECT kind AS token, count(DISTINCT run_id) AS runs FROM ev GROUP BY kind")
def token_frequency(spark: SparkSession, sf: str) -> DataFrame:
    found = seq.sequences(event_log(spark, sf).withColumn("token", F.col("kind")))
    return found.select(F.explode("sequence").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("runs"))


# -- splits and selection

_HASH = "md5('s1|' || CAST({k} AS VARCHAR))"


@query("m01_grouped_split", f"WITH g AS (SELECT p_brand, row_number() OVER (ORDER BY {_HASH.format(k='p_brand')}, p_brand) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey, CASE WHEN rn <= floor(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM part JOIN g USING (p_brand)")
def grouped_split(spark: SparkSession, sf: str) -> DataFrame:
    return ops.grouped_split(table(spark, sf, "part"), "p_brand", 0.3, "s1").select("p_partkey", "split")


@query("m02_row_split", f"SELECT p_partkey, CASE WHEN {_HASH.format(k='p_partkey')} < '4' THEN 'test' ELSE 'train' END AS split FROM part")
def row_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.when(ops.stable_order("s1", "p_partkey") < "4", "test").otherwise("train").alias("split"))


@query("m03_sorted_split", "WITH k AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) AS d FROM part) SELECT p_partkey, CASE WHEN d <= floor((SELECT max(d) FROM k) * 0.5) THEN 'train' ELSE 'test' END AS split FROM k")
def sorted_split(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    kinds = numbered(part.select("p_type").distinct(), [], ["p_type"], F.substring("p_type", 1, 1), "d")
    most = kinds.agg(F.max("d").alias("most"))
    sides = kinds.crossJoin(most).select("p_type", F.when(F.col("d") <= F.floor(F.col("most") * 0.5), "train").otherwise("test").alias("split"))
    return part.join(sides, "p_type").select("p_partkey", "split")


@query("m04_fold_rotation", f"SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY {_HASH.format(k='p_partkey')}) - 1) % 5 AS fold FROM part")
def fold_rotation(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("h", ops.stable_order("s1", "p_partkey"))
    return ops.deal(part, "p_brand", ["h"], 5, bucket_of_hash(F.col("h"))).select("p_partkey", F.col("part").alias("fold"))


@query("m05_family_folds", "WITH f AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), k AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS fold FROM f WHERE n >= 50) SELECT c_custkey, fold FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN k USING (n_name)")
def family_folds(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    both = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), "c_nationkey")  # 25 rows by definition
    names = both.groupBy("n_name").count().filter("count >= 50")
    folds = numbered(names, [], ["n_name"], F.substring("n_name", 1, 1), "place").select("n_name", (F.col("place") - 1).alias("fold"))
    return both.join(folds, "n_name").select("c_custkey", "fold")


@query("m06_volume_shift", "SELECT doc_id, CASE WHEN n_chars < 2000 THEN 'train' ELSE 'measure' END AS side FROM documents")
def volume_shift(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", decisions.volume_side(F.col("n_chars"), 2000).alias("side"))


@query("m07_volume_band", "SELECT doc_id FROM documents WHERE n_chars >= 1000 AND n_chars < 3000")
def volume_band(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(decisions.in_band(F.col("n_chars"), 1000, 3000)).select("doc_id")


@query("m08_volume_match", f"WITH b AS (SELECT d.doc_id, quality, CAST(n_chars >= 1000 AS INT) + CAST(n_chars >= 4000 AS INT) AS band FROM documents d JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT band, min(c) AS least FROM (SELECT band, quality, count(*) AS c FROM b GROUP BY ALL) GROUP BY band HAVING count(*) = 2) SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY band, quality ORDER BY {_HASH.format(k='doc_id')}) AS rn FROM b JOIN c USING (band)) WHERE rn <= least")
def volume_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf)
    return ops.match_volume(rows, stats.band(F.col("n_chars"), [1000, 4000]), "quality", "doc_id").select("doc_id")


@query("m09_two_stage_gate", "SELECT count(*) AS n, count(*) FILTER (n_chars >= 1000) AS passed, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (n_chars < 1000 AND quality = 1) AS lost FROM documents JOIN labels USING (doc_id)")
def two_stage_gate(spark: SparkSession, sf: str) -> DataFrame:
    return decisions.two_stage_gate(_labelled(spark, sf), F.col("n_chars") >= 1000, "quality")


@query("m10_activity_bands", EV + ", r AS (SELECT run_id, count(*) AS n FROM ev GROUP BY 1) SELECT CAST(CAST(n >= 60 AS INT) + CAST(n >= 70 AS INT) AS INT) AS band, count(*) AS runs FROM r GROUP BY 1 HAVING count(*) >= 3")
def activity_bands(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).groupBy("run_id").count().groupBy(stats.band(F.col("count"), [60, 70]).alias("band")).agg(F.count(F.lit(1)).alias("runs")).filter("runs >= 3")


@query("t01_contrast_order", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def contrast_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(20)


@query("t03_most_common", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def most_common(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("t04_natural_sort", "SELECT id, row_number() OVER (ORDER BY length(id), id) AS place FROM (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS id FROM supplier)")
def natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id")).distinct()
    size, head = F.length("id"), F.substring("id", 1, 2)
    return numbered(ids, [], [size, "id"], F.concat(F.lpad(size.cast("string"), 4, "0"), head), "place").select("id", "place")


@query("u01_tagged_union", "SELECT 'c' AS tag, c_custkey AS id, c_acctbal AS bal, NULL::INT AS size FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier UNION ALL SELECT 'p', p_partkey, NULL, p_size FROM part")
def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.lit("c").alias("tag"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    b = table(spark, sf, "supplier").select(F.lit("s").alias("tag"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    c = table(spark, sf, "part").select(F.lit("p").alias("tag"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return a.unionByName(b).unionByName(c, allowMissingColumns=True)


@query("u03_set_operations", "SELECT 'both' AS op, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("op"), "k").unionByName(a.subtract(b).select(F.lit("only").alias("op"), "k"))


@query("u04_membership", "SELECT count(*) AS held FROM (SELECT DISTINCT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return a.intersect(table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))).agg(F.count(F.lit(1)).alias("held"))


@query("w08_round_robin", "SELECT s_suppkey, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) % 3 AS part FROM supplier")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return ops.deal(table(spark, sf, "supplier"), "s_nationkey", ["s_suppkey"], 3).select("s_suppkey", "part")


@query("w09_even_sample", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE n <= 4 OR i = n - 1 OR i = 0 OR i = floor((n - 1) / 3.0) OR i = floor(2 * (n - 1) / 3.0)")
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("o_custkey")
    r = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(by.orderBy("o_orderkey")) - 1).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    places = [F.lit(0), F.floor((F.col("n") - 1) / 3), F.floor(2 * (F.col("n") - 1) / 3), F.col("n") - 1]
    return r.filter((F.col("n") <= 4) | F.array_contains(F.array(*places), F.col("i").cast("long"))).select("o_custkey", "o_orderkey")


@query("w10_inherited_time", EV + "SELECT run_id, pos, last_value(CASE WHEN kind <> 'write' THEN ts END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS line_ts FROM ev")
def inherited_time(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return event_log(spark, sf).select("run_id", "pos", F.last(F.when(F.col("kind") != "write", F.col("ts")), ignorenulls=True).over(by).alias("line_ts"))


# -- manifests


_MANIFEST = "(SELECT o_orderkey AS sha, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'submitted' ELSE 'done' END AS status, o_orderpriority AS family, o_orderdate AS added, CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS notes FROM orders)"


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "submitted").otherwise("done")
    return o.select(F.col("o_orderkey").alias("sha"), status.alias("status"), F.col("o_orderpriority").alias("family"), F.col("o_orderdate").alias("added"), F.when(F.col("o_orderstatus") == "P", F.col("o_custkey").cast("string")).otherwise("").alias("run_id"), F.when(F.col("o_orderkey") % 2 == 0, "x").alias("notes"))


@query("n01_new_or_known", f"SELECT l.k AS sha, m.sha IS NOT NULL AS known FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) l LEFT JOIN {_MANIFEST} m ON m.sha = l.k")
def new_or_known(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("sha")).distinct()
    return ops.attach(asked, _manifest(spark, sf).select("sha"), "sha").select("sha", F.col("matched").alias("known"))


@query("n02_mark_submitted", f"SELECT sha, CASE WHEN sha % 20 = 1 THEN 'analyzed' WHEN sha % 10 = 1 THEN 'submitted' ELSE status END AS status, CASE WHEN sha % 10 = 1 THEN 't' || sha ELSE run_id END AS run_id, CASE WHEN sha % 20 = 1 THEN 'r' || sha END AS result FROM {_MANIFEST} UNION ALL SELECT -p_partkey, 'pending', NULL, NULL FROM part WHERE -p_partkey NOT IN (SELECT o_orderkey FROM orders)")
def mark_submitted(spark: SparkSession, sf: str) -> DataFrame:
    """Rows added that are not there yet, some marked as submitted, and some of these as analyzed."""
    manifest = _manifest(spark, sf).select("sha", "status", "run_id")
    new = table(spark, sf, "part").select((-F.col("p_partkey")).alias("sha")).unionByName(manifest.filter("sha % 3 = 0").select("sha"))
    tasks = manifest.filter("sha % 10 = 1").select("sha", F.concat(F.lit("t"), "sha").alias("run_id"))
    results = manifest.filter("sha % 20 = 1").select("sha", F.concat(F.lit("r"), "sha").alias("result"))
    return decisions.marked_result(decisions.marked_submitted(decisions.added(manifest, new), tasks), results)


@query("n03_summary", f"SELECT family, status, count(*) AS n FROM {_MANIFEST} GROUP BY ROLLUP (family, status)")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf).rollup("family", "status").agg(F.count(F.lit(1)).alias("n"))


@query("n04_write_back", f"SELECT m.sha, coalesce(r.status, m.status) AS status, coalesce(nullif(m.run_id, ''), r.run_id) AS run_id FROM {_MANIFEST} m LEFT JOIN (SELECT ps AS sha, arg_max(p_brand, p_partkey) AS status, 'r' || max(p_partkey) AS run_id FROM (SELECT *, p_partkey // 2 AS ps FROM part) GROUP BY ps) r ON r.sha = m.sha")
def write_back(spark: SparkSession, sf: str) -> DataFrame:
    """Two results for each key, of which the later one counts."""
    results = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 2).alias("sha"), F.col("p_brand").alias("status"), F.concat(F.lit("r"), "p_partkey").alias("run_id"), F.col("p_partkey").alias("at"))
    return ops.write_back(_manifest(spark, sf).select("sha", "status", "run_id"), results, "sha", order="at")


@query("n05_exclude", f"SELECT m.sha, CASE WHEN p_partkey IS NOT NULL AND status = 'pending' THEN 'excluded' ELSE status END AS status, trim(coalesce(notes, '') || CASE WHEN p_partkey IS NOT NULL AND status = 'pending' THEN ';held' ELSE '' END, ';') AS notes FROM {_MANIFEST} m LEFT JOIN part ON p_partkey = m.sha")
def exclude(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "part").select(F.col("p_partkey").alias("sha"))
    return ops.exclude(_manifest(spark, sf).select("sha", "status", "notes"), held, "sha", "held")


@query("n06_reset", f"SELECT sha, CASE WHEN hit THEN 'pending' ELSE status END AS status, CASE WHEN hit THEN '' ELSE run_id END AS run_id FROM (SELECT *, status = 'submitted' AND run_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) AS hit FROM {_MANIFEST})")
def reset(spark: SparkSession, sf: str) -> DataFrame:
    stuck = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"))
    return decisions.reset(_manifest(spark, sf).select("sha", "status", "run_id"), stuck)


@query("n07_pick_pending", f"SELECT sha, turn FROM (SELECT sha, family, row_number() OVER (PARTITION BY family ORDER BY added, sha) AS turn FROM {_MANIFEST} WHERE status = 'pending') ORDER BY turn, family LIMIT 25")
def pick_pending(spark: SparkSession, sf: str) -> DataFrame:
    pending = _manifest(spark, sf).filter("status = 'pending'")
    return ops.in_turns(pending, "family", ["added", "sha"], 25).select("sha", "turn")


@query("n08_in_flight", f"SELECT count(*) AS in_flight FROM {_MANIFEST} WHERE status = 'submitted' AND run_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)")
def in_flight(spark: SparkSession, sf: str) -> DataFrame:
    finished = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"))
    return ops.unseen(_manifest(spark, sf).filter("status = 'submitted'"), finished, "run_id").agg(F.count(F.lit(1)).alias("in_flight"))


@query("n09_first_by_key", "WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS i, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 'h' || l_partkey END AS sha256, 'a/b/' || l_orderkey || '.exe' AS path, l_returnflag AS machine FROM lineitem) SELECT sha256, regexp_extract(path, '([^/]*)$', 1) AS original_filename, 'pending' AS status, 'arch=' || machine || ';subsystem=;is_dll=False' AS notes FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY i) AS rn FROM l WHERE trim(sha256) <> '' AND sha256 IN (SELECT 'h' || p_partkey FROM part WHERE p_size > 10)) WHERE rn = 1")
def first_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """A listing becomes manifest rows: the first of each hash, of what is there."""
    item = table(spark, sf, "lineitem")
    sha = F.when(F.col("l_partkey") % 9 == 0, " ").otherwise(F.concat(F.lit("h"), "l_partkey"))
    listing = item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), sha.alias("sha256"), F.concat(F.lit("a/b/"), "l_orderkey", F.lit(".exe")).alias("path"), F.col("l_returnflag").alias("machine"), F.lit(None).cast("string").alias("subsystem"), F.lit("False").alias("is_dll"))
    present = table(spark, sf, "part").filter("p_size > 10").select(F.concat(F.lit("h"), "p_partkey").alias("sha256"))
    return decisions.manifest_of(listing, present, "list", F.lit("2024-01-01")).select("sha256", "original_filename", "status", "notes")


@query("k10_sorted_manifest", f"SELECT sha, row_number() OVER (ORDER BY added, sha) AS place FROM {_MANIFEST}")
def sorted_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The order in which a manifest is saved, as places: years of the date are the buckets."""
    return numbered(_manifest(spark, sf), [], ["added", "sha"], F.date_format("added", "yyyy-MM"), "place").select("sha", "place")


@query("u02_stable_columns", "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, NULL AS phone, NULL AS size FROM supplier UNION ALL SELECT p_partkey, p_name, NULL, NULL, p_size FROM part")
def stable_columns(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = table(spark, sf, "part").select(F.col("p_size").alias("size"), F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    return decisions.stable_union([a, b], ["k", "name", "phone"])


@query("s11_natural_listing", "SELECT name, row_number() OVER (ORDER BY TRY_CAST(stem AS BIGINT) IS NULL, TRY_CAST(stem AS BIGINT), stem) AS place FROM (SELECT stem || '.png' AS name, stem FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'x' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS stem FROM supplier))")
def natural_listing(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("x"), "s_suppkey")).otherwise(F.col("s_suppkey").cast("string"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("a/shots/"), stem, F.lit(".png")).alias("path"))
    return decisions.pictures(files).select(F.substring_index("path", "/", -1).alias("name"), F.col("shot").cast("long").alias("place"))


@query("p11_fingerprints", "SELECT p_partkey, concat_ws(';', CASE WHEN p_partkey % 2 = 0 THEN 'boost' END, CASE WHEN p_partkey % 3 = 0 THEN 'openssl' END, CASE WHEN p_partkey % 5 = 0 THEN 'wolfssl' END) AS libs FROM part")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat_ws("\n", "p_name", F.when(k % 5 == 0, "x WOLFssl"), F.when(k % 3 == 0, "LibCrypto-1"), F.when(k % 2 == 0, "BOOST"))
    return table(spark, sf, "part").select("p_partkey", decisions.fingerprints(text).alias("libs"))


@query("n10_stratified_split", "SELECT p_partkey, (turn - 1) % 4 AS part FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) WHERE turn <= 12")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return ops.first_turns(table(spark, sf, "part"), "p_brand", ["p_partkey"], 12).select("p_partkey", ((F.col("turn") - 1) % 4).alias("part"))


@query("k03_upsert", "SELECT s_suppkey AS k, s_name AS v FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return ops.upsert(old, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), "k")


@query("k04_unseen_rows", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unseen_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ops.unseen(table(spark, sf, "part").select("p_partkey"), table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


# -- scalar functions

_NAME = r"regexp_extract(url, '([^/]*)$', 1)"


@query("p03_event_path", EV + "SELECT event_id, coalesce(nullif(CASE WHEN kind = 'read' THEN '' ELSE api END, ''), nullif(category, '')) AS path FROM ev")
def event_path(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    return log.select("event_id", paths.event_path(F.when(F.col("kind") == "read", "").otherwise(F.col("api")), F.col("category")).alias("path"))


@query("p04_p08_path_parts", f"SELECT page_id, CASE WHEN contains({_NAME}, '.') THEN lower(regexp_extract({_NAME}, '([^.]*)$', 1)) ELSE '' END AS ext, CASE WHEN contains({_NAME}, '.') THEN lower(regexp_extract({_NAME}, '(\\..*)$', 1)) ELSE '' END AS suffix, replace(regexp_replace(url, '/[^/]*$', ''), '/', '\\') AS dir, regexp_replace({_NAME}, '\\.[^.]*$', '') AS stem FROM pages WHERE contains(url, '/')")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").filter(F.contains(url, F.lit("/"))).select("page_id", paths.extension(url).alias("ext"), paths.dotted_suffix(url).alias("suffix"), paths.directory(url).alias("dir"), paths.base_stem(url).alias("stem"))


@query("p09_contains_any", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token =')")
def contains_any(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(paths.contains_any(F.col("text"), ["License", "token ="])).select("doc_id")


@query("p10_keyword_categories", "SELECT doc_id, CAST(contains(lower(coalesce(text, '')), 'license') AS BIGINT) + CAST(contains(lower(coalesce(text, '')), 'copyright') AS BIGINT) AS legal, CAST(contains(lower(coalesce(text, '')), 'the') AS BIGINT) + CAST(contains(lower(coalesce(text, '')), 'and') AS BIGINT) AS english FROM documents")
def keyword_categories(spark: SparkSession, sf: str) -> DataFrame:
    found = decisions.keyword_counts(F.col("text"), {"legal": ["License", "copyright"], "english": ["the", "and", "the"]})
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in found.items()])


@query("p12_token_rules", "SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '(?i)licensed?\\s+under') THEN 'license' END, CASE WHEN regexp_matches(text, 'token = \"[0-9a-f]{40}\"') THEN 'secret' END, CASE WHEN regexp_matches(text, '[0-9]{16}') THEN 'number' END], lambda x: x IS NOT NULL)) AS token FROM documents")
def token_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"license": r"(?i)licensed?\s+under", "secret": 'token = "[0-9a-f]{40}"', "number": "[0-9]{16}"}
    marks = F.array_compact(F.array(*[F.when(F.col("text").rlike(r), F.lit(t)) for t, r in rules.items()]))
    return table(spark, sf, "documents").select("doc_id", F.explode(marks).alias("token"))


@query("p14_p15_names", "SELECT p_partkey, translate(lower(p_name), ' _-.!', '') AS flat, coalesce(map_extract(MAP {'brand#1': 'one'}, lower(trim(p_brand)))[1], trim(p_brand)) AS brand FROM part")
def names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", paths.collapsed(F.col("p_name")).alias("flat"), paths.canonical(F.col("p_brand"), {"brand#1": "one"}).alias("brand"))


@query("p16_variant_kind", "SELECT c_custkey, array_to_string(list_filter(string_split('xc_' || c_mktsegment || '_l' || c_custkey || '_rand_r3', '_'), lambda t: t <> '' AND NOT regexp_matches(t, '^[lr][0-9]+$'))[1:3], '_') AS kind FROM customer")
def variant_kind(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("xc_"), "c_mktsegment", F.lit("_l"), "c_custkey", F.lit("_rand_r3"))
    return table(spark, sf, "customer").select("c_custkey", paths.variant_kind(name).alias("kind"))


@query("p17_source_prefix", "SELECT c_custkey, CASE WHEN starts_with(CAST(c_custkey AS VARCHAR), '10') THEN 'A' WHEN starts_with(CAST(c_custkey AS VARCHAR), '1') THEN 'B' ELSE 'C' END AS source FROM customer")
def source_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", paths.source_of(F.col("c_custkey").cast("string"), {"10": "A", "1": "B"}, "C").alias("source"))


@query("p21_safe_number", "SELECT o_orderkey, TRY_CAST(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 1 THEN '' ELSE CAST(o_custkey AS VARCHAR) END), '') AS DOUBLE) AS x FROM orders")
def safe_number(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, "n/a").when(F.col("o_orderkey") % 3 == 1, "").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", safe.number(text).alias("x"))


@query("p26_p27_predicates", EV + "SELECT run_id, count(*) >= 60 AS covered, count(DISTINCT api) >= 20 AS readable FROM ev GROUP BY run_id")
def predicates(spark: SparkSession, sf: str) -> DataFrame:
    per = event_log(spark, sf).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("api").alias("imports"))
    return per.select("run_id", (F.col("n") >= 60).alias("covered"), decisions.readable(F.col("imports")).alias("readable"))


@query("p30_digest", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def digest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


@query("s09_header_cascade", "WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 0 ELSE p_size * 1200000 END AS size, p_partkey % 7 <> 0 AS parses, CASE p_partkey % 5 WHEN 0 THEN 8192 + 2 WHEN 1 THEN 4096 ELSE 258 END AS flags, p_partkey % 4 AS subsystem, p_partkey % 3 AS entry FROM part), r AS (SELECT p_partkey, CASE WHEN size IS NULL THEN 'STAT_ERROR' WHEN size = 0 THEN 'EMPTY_FILE' WHEN size > 52428800 THEN 'OVERSIZE' WHEN NOT parses THEN 'NOT_PE' WHEN flags & 8192 <> 0 THEN 'DLL' WHEN subsystem = 1 OR flags & 4096 <> 0 THEN 'DRIVER_OR_NATIVE' WHEN entry = 0 THEN 'NO_ENTRY_POINT' ELSE 'OK' END AS reason FROM h) SELECT p_partkey, CASE WHEN reason = 'OK' THEN 'SUBMIT' ELSE 'SKIP' END AS decision, reason FROM r")
def header_cascade(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    size = F.when(k % 31 == 0, None).when(k % 29 == 0, 0).otherwise(F.col("p_size") * 1_200_000)
    flags = F.when(k % 5 == 0, 0x2000 + 2).when(k % 5 == 1, 0x1000).otherwise(258)
    decision, reason = decisions.header_decision(size, k % 7 != 0, flags, k % 4, k % 3)
    return table(spark, sf, "part").select("p_partkey", decision.alias("decision"), reason.alias("reason"))


@query("s14_best_asset", "WITH a AS (SELECT s_nationkey AS repo, s_suppkey, CAST(s_suppkey * 300000 AS BIGINT) AS size, (['setup.exe', 'setup-arm64.exe', 'tool.msi', 'setup-debug.exe', 'tool.deb'])[s_suppkey % 5 + 1] AS name FROM supplier) SELECT repo, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY size DESC, s_suppkey) AS rn FROM a WHERE name IN ('setup.exe', 'tool.msi') AND size BETWEEN 100000 AND 25000000) WHERE rn = 1")
def best_asset(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in ("setup.exe", "setup-arm64.exe", "tool.msi", "setup-debug.exe", "tool.deb")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    assets = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("repo"), "s_suppkey", (F.col("s_suppkey") * 300_000).alias("size"), name.alias("name"))
    return decisions.best_asset(assets, "repo", "name", "size", 25, "s_suppkey").select("repo", "s_suppkey")