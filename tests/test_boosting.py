"""Trees and margins of all folds together against a plain growth of each fold's trees, one after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, ml
from tidemark.operators.boosting import Boosting


def plain(x, y, use, number, how, weight):
    """Margins of one fold, row by row and cut by cut."""
    margins = np.zeros(len(y))
    for t in range(how.trees):
        p, w = 1 / (1 + np.exp(-margins)), np.where(y == 1, weight, 1.0)
        g, h = w * (p - y), w * p * (1 - p)
        seen = use & boosting.in_sample(number, t, how.share)
        value = lambda at: -how.rate * g[at & seen].sum() / (h[at & seen].sum() + how.l2)  # noqa: B023,E731

        def grow(at, depth):
            best = (1e-9, None)
            if depth < how.depth:
                score = lambda z: g[z & seen].sum() ** 2 / (h[z & seen].sum() + how.l2)
                for f in range(x.shape[1]):
                    for missing in (False, True):
                        for cut in range(1, how.bins):
                            right = at & np.where(x[:, f] == 0, missing, x[:, f] > cut)
                            left = at & ~right
                            if h[left & seen].sum() >= how.least and h[right & seen].sum() >= how.least:
                                gain = score(left) + score(right) - score(at)
                                if gain > best[0] + 1e-9:
                                    best = (gain, (left, right))
            if best[1] is None:
                return [(at, value(at))]
            return grow(best[1][0], depth + 1) + grow(best[1][1], depth + 1)

        for at, v in grow(np.ones(len(y), bool), 0):
            margins[at] += v
    return margins


@pytest.mark.parametrize("small", [0, 20_000])
def test_margins_equal_plain_trees(spark, monkeypatch, small):
    monkeypatch.setattr(boosting, "SMALL", small)
    monkeypatch.setattr(boosting, "KEEP", 2)
    rng = np.random.default_rng(5)
    n, how = 160, Boosting(trees=5, depth=3, bins=6, rate=0.3, least=0.5)
    x = rng.integers(0, 7, (n, 4)).astype(np.uint8)
    y = (x[:, 0] + rng.normal(size=n) * 2 > 3).astype(int)
    held = rng.integers(-2, 3, n)
    number = rng.integers(0, 2**60, n)
    rows = [(int(i), int(a), int(b), bytearray(c.tobytes())) for i, a, b, c in zip(number, y, held, x, strict=True)]
    df = spark.createDataFrame(rows, "number long, y int, held int, x binary").repartition(3)
    margins, trees, own = boosting.boost(df, 4, 3, how)
    got = {r.number: r.margins for r in margins.collect()}
    own.clear()
    assert len(trees) == 5
    for k in range(3):
        use = (held != k) & (held > -2)
        weight = max(1.0, (use & (y == 0)).sum() / (use & (y == 1)).sum())
        want = plain(x, y, use, number, how, weight)
        assert np.allclose([got[int(i)][k] for i in number], want, atol=1e-9)


def test_bins_keep_order_and_mark_what_is_missing(spark):
    values = [None, float("nan"), -1.0, 0.0, 0.0, 0.5, 2.0, 9.0, 9.0, 1e9]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(values)], "i int, a double, b double")
    edges = boosting.edges_of(df, ["a", "b"], 4)
    bins = [tuple(r.x) for r in boosting.binned(df, ["a", "b"], edges, ["i"]).orderBy("i").collect()]
    assert [b[0] for b in bins][:2] == [0, 0]
    known = [b[0] for b in bins][2:]
    assert known == sorted(known) and known[0] >= 1 and known[-1] <= 5 and len(set(known)) >= 3
    assert {b[1] for b in bins} == {1}


def test_boosting_as_a_classifier_of_folds(spark):
    rng = np.random.default_rng(0)
    rows = [(f"s{i}", int(i < 90), f"f{i % 3}" if i < 90 else "n", float(rng.normal() + 3 * (i < 90)), float(rng.normal()), None if i % 9 == 0 else 1.0) for i in range(300)]
    told = spark.createDataFrame(rows, "sample_id string, y int, family string, a double, b double, c double")
    for folds in (16, 2):
        boosting_folds, boosting.FOLDS = boosting.FOLDS, folds
        try:
            scored = ml.leave_one_out(told, ["a", "b", "c"], "family", Boosting(trees=12), hard=F.col("sample_id").isin("s290", "s291")).collect()
        finally:
            boosting.FOLDS = boosting_folds
        assert sorted(r.sample_id for r in scored if r.part != "hard") == sorted(r[0] for r in rows if r[0] not in ("s290", "s291"))
        assert {(r.sample_id, r.fold) for r in scored if r.y == 1} == {(f"s{i}", f"f{i % 3}") for i in range(90)}
        assert {(r.sample_id, r.fold) for r in scored if r.part == "hard"} == {(s, f"f{k}") for s in ("s290", "s291") for k in range(3)}
        right = np.mean([(r.score >= 0.5) == r.y for r in scored])
        assert right > 0.85


def test_jobs_of_a_small_table_do_not_grow_with_its_trees(spark):
    rows = [(i, i % 3 % 2, i % 2, bytearray([i % 5, i % 7])) for i in range(60)]
    df = spark.createDataFrame(rows, "number long, y int, held int, x binary")
    jobs = []
    for trees in (2, 20):
        spark.sparkContext.setJobGroup(f"boost {trees}", "")
        _, _, own = boosting.boost(df, 2, 2, Boosting(trees=trees, depth=2, bins=6))
        own.clear()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boost {trees}")))
    assert jobs[0] == jobs[1] > 0
