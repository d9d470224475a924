"""Ranked search against a plain reading of the definition."""

import collections
import math
import random
import re

import pyarrow as pa
import pytest

from tidemark.llm import search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    rows = [(i, collections.Counter(terms(t))) for i, t in docs]
    rows = [(i, c, sum(c.values())) for i, c in rows if c]
    total, length = len(rows), sum(n for *_, n in rows)
    df = collections.Counter(t for _, c, _ in rows for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = collections.Counter()
    for item, ts in wanted.items():
        found = []
        for i, c, n in rows:
            m = 10 + 90 * n * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out.update((item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k]))
    return out


@pytest.mark.parametrize(("size", "block", "fan"), [(4 << 20, 8192, 64), (60, 7, 2)])
def test_ranked(spark, odd_docs, no_docs, monkeypatch, size, block, fan):
    monkeypatch.setattr(search, "ITEM_BYTES", size)
    monkeypatch.setattr(search, "DOCUMENTS", block)
    monkeypatch.setattr(search, "FAN", fan)
    rng = random.Random(4)
    words = ["the", "ON", "er", "Ünï", "x9", "thé", "K", "K", "averyveryverylongterm", "averyveryverylongtern", "averyveryVerylongterm1", "日本"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", "\0"]) for _ in range(rng.randint(0, 25)))
    df, texts = odd_docs
    docs = [*texts, *((1000 + i, text()) for i in range(80)), (None, "the on x9 thé"), (1005, "the x9"), (1005, "the x9")]
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, n long, terms string").repartition(6)
    items = [(i, text()) for i in range(9)] + [(3, "日本 the"), (20, None), (21, "..."), (22, "nowhere"), (None, "thé ünï Ünï")]
    queries = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, item int")
    got = search.ranked(frame, queries, 5)
    assert collections.Counter(map(tuple, got.collect())) == brute(docs, items, 5)
    assert search.ranked(no_docs, queries).count() == 0
    assert search.ranked(frame, queries.limit(0)).count() == 0


def test_terms_are_told_apart_by_their_bytes():
    known = search.Vocabulary(["abcdefgh", "abcdefghi", "abcdefghijklmnopq", "é"])
    texts = ["ABCDEFGH abcdefghi", "abcdefghijklmnopr abcdefghijklmnopq é e"]
    found = search.Terms(pa.array(texts))
    assert [terms(" ".join(texts))[i] for i in known.lookup(found)[0]] == ["abcdefgh", "abcdefghi", "abcdefghijklmnopq", "é"]


def test_a_hash_that_agrees_is_not_enough():
    known = search.Vocabulary(["abcdefghijkl"])
    found = search.Terms(pa.array(["abcdefghijkm"]))
    known.hashes = found.hashes.copy()
    assert len(known.lookup(found)[0]) == 0
