"""Exact dedup, substring dedup and the Jaccard join against brute force."""

import collections
import hashlib
import random

import pytest

from tidemark.llm import common, exact_dedup, jaccard, substrings
from tidemark.llm.components import components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(5, 5), (160, 100), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 161)} | {200: 200, 201: 200}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [10_000, 20])
def test_exact_groups(spark, odd_docs, no_docs, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    df, texts = odd_docs
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()} == want
    assert {r.doc_id for r in exact_dedup.drop_exact_copies(df).collect()} == {i for i, w in want.items() if w[2]}
    assert exact_dedup.exact_groups(no_docs).count() == 0
    twice = exact_dedup.exact_groups(df.filter("doc_id < 5").union(df.filter("doc_id < 5"))).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in twice) == [x for i, k, n in ((0, 1, 4), (1, 1, 4), (2, 2, 2), (3, 4, 4), (4, 4, 4)) for x in [(i, k, n, i == k)] * 2]


def test_a_text_stays_though_its_id_is_dropped_with_another(spark):
    rows = [(5, "a", "x"), (5, "b", "y"), (9, "a", "z"), (9, "a", "z"), (None, "a", "n"), (None, "c", "n"), (None, "c", "n"), (7, None, "e"), (8, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _full string")
    kept = sorted((tuple(r) for r in exact_dedup.drop_exact_copies(df).collect()), key=repr)
    assert kept == sorted([(5, "b", "y"), (9, "a", "z"), (9, "a", "z"), (None, "c", "n"), (None, "c", "n"), (8, "", "e")], key=repr)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()}
    assert got == {(5, 9, 4, False), (5, 5, 1, True), (9, 9, 4, True), (None, 9, 4, False), (None, None, 2, True), (7, 8, 2, False), (8, 8, 2, True)}


def test_bounded_filter_has_no_false_negative(spark, monkeypatch):
    rows = spark.range(5000)
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "key")
    for words in (1 << 19, 1024):
        monkeypatch.setattr(common, "FILTER_WORDS", words)
        out = common.bounded_filter(rows, keys, rows.id).filter("maybe")
        assert set(range(0, 5000, 7)) <= {r.id for r in out.collect()}
        assert out.count() < 1500


@pytest.mark.parametrize("least", [1, 40, 10**6])
def test_join_counted(spark, least):
    rows = spark.createDataFrame([(k, i) for k in (1, 2, 3) for i in range(k * 30)] + [(None, 0)], "k long, i long")
    answers = spark.createDataFrame([(1, "a", 30), (2, "b", 60), (4, "d", 1)], "k long, x string, _n long")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(answers.drop("_n"), "k", how).collect()), key=repr)
        assert sorted(map(tuple, common.join_counted(rows, answers, "k", 120, how, least).collect()), key=repr) == want


def test_no_shared_folder_on_a_cluster_is_an_error():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_scratch_tables_go(spark):
    import os

    def build():
        built.append(common.written(spark, spark.range(3), "inner").inputFiles()[0])
        return spark.range(4)

    built = []
    kept = common.settled(spark, build, "outer")
    assert kept.count() == 4 and not os.path.exists(built[0].removeprefix("file://"))
    with pytest.raises(ValueError):
        common.discard(spark, "/tmp")


def brute_repeats(texts, window):
    seen, out = set(), {}
    for i, t in sorted(texts):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize("batch", [7, 10_000])
def test_substrings(spark, odd_docs, no_docs, batch):
    df, texts = odd_docs
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substrings.without_repeats(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_repeats(texts, 20)
    assert substrings.without_repeats(no_docs).count() == 0


def shingles(t, n):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (t or "").encode().split()]
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 1_500_000), (5, 80, 3000), (4, 60, 900)])
def test_near_groups(spark, odd_docs, no_docs, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "VECTORS", block // 150)
    df, texts = odd_docs
    sets = {i: shingles(t, n) for i, t in texts}
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    want = {i: (len(s), find(parent, i)) for i, s in sets.items()}
    assert len({w[1] for w in want.values()}) < len(want) - 60
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_groups(df, n, percent).collect()} == want
    assert {r.doc_id for r in jaccard.one_of_each(df, n, percent).collect()} == {i for i, w in want.items() if w[1] == i}
    assert jaccard.near_groups(no_docs).count() == 0


def test_near_copies_with_repeated_and_null_ids(spark):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(2, long, 1), (5, long + " end", 2), (5, other, 3), (5, other, 4), (9, "x " + other, 5), (None, long, 6), (None, None, 7), (7, "", 8), (None, "alone", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    assert sorted(r.key for r in jaccard.one_of_each(df).collect()) in ([1, 3, 7, 8, 9], [1, 4, 7, 8, 9])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_groups(df).collect()), key=repr)
    assert got == sorted([(2, 56, 2), (5, 57, 2), (5, 56, 2), (5, 56, 2), (9, 57, 2), (None, 56, None), (None, 0, None), (7, 0, 7), (None, 1, None)], key=repr)


def test_keys_lose_no_link():
    """Pairs at the very threshold share a key, for all sizes."""
    import numpy as np

    rng = np.random.default_rng(0)
    limit = jaccard.Threshold(85)
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(5):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
            gone = rng.integers(0, len(a) + 1)
            b = a
            for k in range(int(gone), 0, -1):
                new = np.unique(np.r_[rng.choice(a, len(a) - k // 2, replace=False), rng.integers(0, 1 << 63, k - k // 2, dtype=np.uint64)])
                if limit.linked(len(np.intersect1d(a, new)), len(a), len(new)):
                    b = new
                    break
            keys, doc = jaccard.keys_of(np.r_[a, b], np.array([len(a), len(b)]), limit)
            assert np.array_equal(a, b) or set(keys[doc == 0]) & set(keys[doc == 1])


@pytest.mark.parametrize("percent", [80, 85])
def test_keys_lose_no_short_link(percent):
    """Many pairs of each short size at the threshold: groups that agree may all be empty ones."""
    import numpy as np

    rng = np.random.default_rng(1)
    limit = jaccard.Threshold(percent)
    lost = {}
    for a in range(2, 21):
        for b in range(1, a + 1):
            both = next((k for k in range(1, b + 1) if limit.linked(k, a, b)), b + 1)
            if both > b or both == a == b:
                continue
            pairs = 600 if a > 12 else 3000
            drawn = rng.integers(0, 1 << 63, (pairs, a + b - both), dtype=np.uint64)
            sets = [s for row in drawn for s in (np.sort(row[:a]), np.sort(row[a - both :]))]
            keys, doc = jaccard.keys_of(np.concatenate(sets), np.array([len(s) for s in sets]), limit)
            found = np.unique(np.stack([keys, doc // 2, doc % 2], 1), axis=0)
            same = (found[1:, 0] == found[:-1, 0]) & (found[1:, 1] == found[:-1, 1])
            missing = pairs - len(np.unique(found[1:, 1][same]))
            if missing:
                lost[a, b, both] = missing
    assert lost == {}


@pytest.mark.parametrize("parts", [1, 9])
def test_a_key_of_many_rows_spans_tasks(spark, parts):
    rows = [(7, i) for i in range(3_000)] + [(k, 10_000 + 3 * k + j) for k in range(40) for j in range(k % 4)] + [(8, 2_999), (8, 5_000), (-5, 9_000)] + [(9, 6_000)] * 50
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = jaccard._starred(spark, spark.createDataFrame(rows, "key long, id long")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parent = {i: i for _, i in rows}
    for r in found:
        parent[find(parent, r.a)] = find(parent, r.b)
    groups = collections.defaultdict(set)
    for k, i in rows:
        groups[k].add(i)
    assert all(len({find(parent, i) for i in g}) == 1 for g in groups.values())
    assert len({find(parent, i) for i in parent}) == len({min(g) for g in groups.values()}) - 1
    assert len(found) <= len(rows) + 2 * parts


@pytest.mark.parametrize("few", [2, 8])
def test_a_passage_of_many_documents_joins_no_cluster(spark, monkeypatch, few):
    """Documents with a passage of one another's, and edited copies of some: only the copies are compared, all are found."""
    rng = random.Random(3)
    word = lambda: f"{rng.randrange(1 << 40):x}"
    passages = [[word() for _ in range(60)] for _ in range(6)]
    texts = []
    for i in range(240):
        words = [word() for _ in range(300)]
        words[100:100] = passages[i % 6]
        words[30:30] = passages[(i // 6) % 6]
        texts.append((10 * i, words))
    for i in range(0, 240, 8):
        for k in range(1, 4):
            words = list(texts[i][1])
            for at in rng.sample(range(400), 2 * k):
                words[at] = word()
            texts.append((10 * i + k, words))
    sizes, split = [], jaccard._split

    def seen(spark, clusters, *rest):
        sizes.append(max(r[1] for r in clusters.groupBy("cluster").count().collect()))
        return split(spark, clusters, *rest)

    monkeypatch.setattr(jaccard, "_split", seen)
    monkeypatch.setattr(jaccard, "FEW", few, raising=False)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(df, 5, 80).collect()}
    assert got == {i: i // 10 * 10 for i, _ in texts} and sizes[0] <= 16
