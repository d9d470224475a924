"""Shards along the Hilbert curve against a plain recomputation of the order."""

import bisect
import collections
import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, sharding

TABLE = "/root/testdata/sf0.001"


def place(bins, bits):
    digits, following = sharding.hilbert_states(len(bins))
    at = state = 0
    for i in reversed(range(bits)):
        k = (state << len(bins)) + sum((b >> i & 1) << j for j, b in enumerate(bins))
        at, state = (at << len(bins)) | digits[k], following[k]
    return at


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_once_by_unit_steps(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    found = sorted((place(c, bits), c) for c in cells)
    assert [p for p, _ in found] == list(range(len(cells)))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in itertools.pairwise(found))
    names = [f"c{i}" for i in range(n)]
    df = spark.createDataFrame(cells, ", ".join(f"{c} int" for c in names))
    got = df.select(sharding.curve_index([F.col(c) for c in names], bits).alias("p"), F.struct(*names).alias("c")).collect()
    assert sorted((r.p, tuple(r.c)) for r in got) == found


def test_size_class_keeps_order(spark):
    sizes = [*range(1, 3000), *(2**k + d for k in range(12, 40) for d in (-1, 0, 1))]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.size_class(F.col("s"))).collect()]
    assert got == [((s << 10) >> (s.bit_length() - 1)) + 1024 * (s.bit_length() - 1) for s in sizes]
    assert got == sorted(got)


def bins(values, bits):
    """The bin of each value's middle, in the order of the values."""
    order = sorted(values)
    middle = lambda v: bisect.bisect_left(order, v) + bisect.bisect_right(order, v)
    return [(middle(v) << bits) // (2 * len(order)) for v in values]


def test_query_puts_runs_of_the_curve_into_shards(spark):
    docs = spark.read.parquet(f"{TABLE}/documents.parquet").collect()
    sizes = [len((d.text or "").encode()) + 1 for d in docs]
    classes = [((s << 10) >> (s.bit_length() - 1)) + 1024 * (s.bit_length() - 1) for s in sizes]
    cells = zip(bins([d.lang or "" for d in docs], 5), bins([d.source or "" for d in docs], 5), bins(classes, 5), strict=True)
    rows = sorted((place(c, 5), hashlib.md5((d.text or "").encode()).digest(), d.doc_id, s, zlib.crc32((d.text or "").encode())) for c, d, s in zip(cells, docs, sizes, strict=True))
    want, slots = [], collections.Counter()
    for rank, (curve, _, doc_id, size, crc) in enumerate(rows):
        shard = rank * 16 // len(rows)
        want.append((doc_id, size, crc, "rows", shard, slots[shard], None, curve))
        slots[shard] += 1
    assert sorted(map(tuple, sharding.op12_hilbert_sharding(spark, TABLE).collect())) == sorted(want)
    assert max(slots.values()) - min(slots.values()) <= 1


def test_write_shards(spark, odd_docs, no_docs):
    df, texts = odd_docs
    rows = df.union(df.filter("doc_id = 4")).union(df.filter("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).union(df.filter("doc_id = 10").crossJoin(spark.range(150)).drop("id"))
    rows = rows.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang"))).withColumns({"shard": F.lit("s"), "slot": F.lit(1), "a`b": F.lit(2)})
    path = common.own_path(spark, "test-shards")
    out = sharding.write_shards(rows, path, [F.col("lang"), F.col("doc_id")], 7)
    assert sorted(map(repr, out.select("document.*").collect())) == sorted(map(repr, rows.collect()))
    per = {r["shard"]: (r.n, r.slots, r.most) for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("most")).collect()}
    assert sorted(per) == list(range(7))
    assert all(n == s == m + 1 for n, s, m in per.values())
    assert max(n for n, *_ in per.values()) - min(n for n, *_ in per.values()) <= 1
    assert sharding.write_shards(no_docs, common.own_path(spark, "test-shards"), [F.col("lang")]).count() == 0
    few = sharding.write_shards(rows.limit(3), common.own_path(spark, "test-shards"), [F.col("lang")], 16)
    assert few.groupBy("shard").count().filter("count > 1").count() == 0
    assert few.count() == 3


def test_filters_touch_few_shards(spark):
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("site"), F.col("id") % 29).alias("source"), (F.xxhash64("id") % 1000).alias("q"))
    out = sharding.write_shards(rows, common.own_path(spark, "test-shards"), [F.col("source"), F.col("q"), F.col("doc_id")], 64)
    boxes = out.groupBy("shard").agg(*[f(F.col(f"document.{c}")).alias(f"{c}_{f.__name__}") for c in ("source", "q", "doc_id") for f in (F.min, F.max)]).collect()
    for c, value in (("source", "site17"), ("q", 250), ("doc_id", 4_321)):
        assert sum(b[f"{c}_min"] <= value <= b[f"{c}_max"] for b in boxes) <= 28
