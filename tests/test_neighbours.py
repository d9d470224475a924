"""Nearest neighbours over all components against brute force."""

import pytest

from tidemark.operators import ml
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("sizes", [(20_000, 2_000), (40, 2)])
def test_nearest_over_all_components(spark, monkeypatch, sizes):
    import numpy as np

    monkeypatch.setattr(ml, "ASKED", sizes[1])
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    ids, y = np.array([r.vec_id for r in raw]), np.array([int(r.label < 5) for r in raw])
    points = np.array([r.embedding for r in raw], float)
    want = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((points - points[q]) ** 2).sum(1)
        order = [k for k in np.lexsort((ids, d)) if k != q][:5]
        want[int(ids[q])] = [int(ids[k]) for k in order], int(y[order].sum())
    rows = spark.createDataFrame([(int(i), int(t), p.tolist()) for i, t, p in zip(ids, y, points, strict=True)], "vec_id long, y int, vector array<double>")
    found = ml.nearest(rows, rows.filter("vec_id % 100 = 0"), 5, sizes[0]).orderBy("asked", "d", "vec_id").collect()
    assert {q: [r.vec_id for r in found if r.asked == q] for q in want} == {q: n for q, (n, _) in want.items()}
    assert {r.vec_id: r.positive_neighbours for r in catalog.QUERIES["e16_nearest_neighbours"](spark, SF).collect()} == {q: s for q, (_, s) in want.items()}


@pytest.mark.parametrize(("cell", "k"), [(60, 4), (7, 1), (500, 9), (2, 30)])
def test_cells_lose_no_neighbour(spark, cell, k):
    """Clusters, equal points, ties, rows that are far from all others, and asked vectors that are no rows."""
    import numpy as np

    rng = np.random.default_rng(cell)
    points = np.concatenate([rng.normal(size=(40, 3)) * s + c for s, c in ((0.1, 0), (0.1, 9), (3, 4), (0, 2))] + [np.array([[500.0, 0, 0], [-400.0, 1, 1]])])
    points = np.round(points, 1)
    asked = np.concatenate([points[::9], rng.normal(size=(4, 3)) * 20])
    rows = spark.createDataFrame([(i, i % 2, p.tolist()) for i, p in enumerate(points)], "vec_id long, y int, vector array<double>").repartition(3)
    names = [*range(0, len(points), 9), *range(1000, 1004)]
    found = ml.nearest(rows, spark.createDataFrame([(i, p.tolist()) for i, p in zip(names, asked, strict=True)], "vec_id long, vector array<double>"), k, cell).orderBy("asked", "d", "vec_id").collect()
    for name, p in zip(names, asked, strict=True):
        d = ((points - p) ** 2).sum(1)
        order = [int(i) for i in np.lexsort((np.arange(len(d)), d)) if i != name][:k]
        assert [r.vec_id for r in found if r.asked == name] == order
    assert ml.nearest(rows.limit(0), rows.select("vec_id", "vector"), k).count() == 0


def test_rows_that_fit_into_a_task_are_one_cell(spark, monkeypatch):
    seen, plain = [], ml._matrix
    monkeypatch.setattr(ml, "_matrix", lambda column: seen.append(len(column)) or plain(column))
    rows = spark.range(6_000).selectExpr("id AS vec_id", "cast(id % 2 AS int) AS y", "array(cast(id AS double), 1D) AS vector")
    ml.nearest(rows, rows.filter("vec_id < 0").select("vec_id", "vector"), 5)
    assert seen[0] == 1  # pivots
