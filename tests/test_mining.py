"""Mining over whole runs against brute force, on runs whose tokens come late; ranks in buckets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks, sequences, stats, tables
from tidemark.plans import catalog

KINDS = {"view": "read", "click": "write", "purchase": "move", "error": "delete", "signup": "execute"}


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """A folder with an events table, and the first-evidence sequence of each run in it."""
    rng, rows, found = random.Random(3), [], {}
    for run in range(60):
        kinds = rng.sample(sorted(KINDS), 5) if rng.random() < 0.5 else sorted(KINDS)
        events = [kinds[0]] * 9 + [k for k in kinds[1 : rng.randint(2, 5)] for _ in range(3)]
        rows += [(run * 100 + i, run, k, f"2024-01-01 00:{i:02d}:00", '{"k": 1}', 1.0) for i, k in enumerate(events)]
        found[run] = [KINDS[k] for k in dict.fromkeys(events)]
    path = str(tmp_path_factory.mktemp("late"))
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, props string, value double").selectExpr("event_id", "user_id", "event_type", "timestamp(ts) ts", "props", "value").write.parquet(f"{path}/events.parquet")
    return path, found


def counts(found):
    out = {}
    for s in found:
        for n in range(1, 6):
            for p in itertools.combinations(s, n):
                out[">".join(p)] = out.get(">".join(p), 0) + 1
    return out


def test_whole_runs_are_mined(spark, late):
    path, found = late
    run = lambda name: catalog.QUERIES[name](spark, path).collect()
    every = counts(found.values())
    want = {p: c for p, c in every.items() if c >= 6}
    assert max(p.count(">") for p in want) == 4
    assert {r.pattern: r.support_count for r in run("g01_frequent_patterns")} == want
    assert {r.pattern: r.support_count for r in run("g02_pair_support")} == {p: c for p, c in every.items() if c >= 15 and p.count(">") == 1}
    pos, neg = (counts(s for k, s in found.items() if k % 2 == y) for y in (1, 0))
    want = {(p, p.count(">") + 1, c, neg.get(p, 0)) for p, c in pos.items() if c >= 10 and c / 30 - neg.get(p, 0) / 30 >= 0.02}
    assert want and {(r.pattern, r.length, r.pos_hits, r.neg_hits) for r in run("g03_contrast")} == want
    holds = lambda s, p: int(all(x in i for i in [iter(s)] for x in p.split(">")))
    best = [p for p, _, c, n in sorted(want, key=lambda w: (-round(w[2] / 30 - w[3] / 30, 9), w[0]))][:3]
    assert {tuple(r) for r in run("g04_pattern_matrix")} == {(k, *[holds(s, p) for p in best]) for k, s in found.items()}


def test_too_many_candidates_are_an_error(spark):
    found = spark.createDataFrame([(i, list("abcdef")) for i in range(3)], "run_id int, sequence array<string>")
    assert sequences.frequent_patterns(found, 0.0, 6).count() == 63
    with pytest.raises(ValueError):
        sequences.frequent_patterns(found, 0.0, 6, most=10)


@pytest.mark.parametrize("n", [1, 2, 7, 300])
def test_ranks_in_buckets(spark, monkeypatch, n):
    rng = random.Random(n)
    rows = [(g, rng.choice([rng.randint(0, 5), rng.random() * 100]), rng.randint(0, 1), i) for g in "ab" for i in range(n)] + [("c", None, 0, 0)]
    df = spark.createDataFrame([(g, None if v is None else float(v), y, i) for g, v, y, i in rows], "g string, value double, y int, i int")
    mids = {r.g: r.mid for r in ranks.upper_medians(df.filter("value is not null"), ["g"], "value").collect()}
    of = lambda g: [(float(v), y) for x, v, y, _ in rows if x == g and v is not None]
    assert mids == {g: sorted(v for v, _ in of(g))[len(of(g)) // 2] for g in "ab"}
    for r in stats.auc(df.filter("value is not null"), ["g"]).collect():
        pos, neg = [v for v, y in of(r.g) if y], [v for v, y in of(r.g) if not y]
        want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert r.auc == want or abs(r.auc - want) < 1e-12
    placed = ranks.numbered(df.withColumn("h", F.md5(F.col("i").cast("string"))), ["g"], ["h"], ranks.bucket_of_hash(F.col("h")), "place")
    for g in "ab":
        own = sorted((r.h, r.place) for r in placed.filter(F.col("g") == g).collect())
        assert [p for _, p in own] == list(range(1, n + 1))


def test_first_turns(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("i"))
    got = sorted((r.g, r.i, r.turn) for r in tables.first_turns(rows, "g", ["i"], 2).collect())
    assert got == [(g, g + 3 * k, k + 1) for g in range(3) for k in range(2)]
    assert [(r.g, r.turn) for r in tables.in_turns(rows, "g", ["i"], 4).collect()] == [(0, 1), (1, 1), (2, 1), (0, 2)]
