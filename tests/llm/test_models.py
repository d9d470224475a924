"""Toxicity, personal data, embeddings and the pipeline."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import embeddings, pii, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "lo", "ni", "ter", "mu", "sa"]) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [word() for _ in range(rng.randint(5, 80))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["grumfek", "zotwix"]))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    texts += [(1000, None), (1001, "")]
    labels += [(1000, None, None), (5, 1, 0), (7777, 0, 1)]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(texts)


def test_toxicity(spark, labelled, odd_docs, no_docs):
    docs, labels, texts = labelled
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).withColumn("held", toxicity.held_out("doc_id")).collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held and r.doc_id < 600]
    assert sum((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert sorted(r.doc_id for r in toxicity.without_toxic(docs, model).collect()) == sorted(r.doc_id for r in rows if r.score < 0.3)
    df, odd = odd_docs
    assert toxicity.scored(df, model).count() == len(odd) and toxicity.scored(no_docs, model).count() == 0
    assert toxicity.without_toxic(df, model).columns == df.columns
    for y, want in ((1, 1.0), (0, 0.0)):
        one = toxicity.train(docs, labels.filter(f"toxic = {y}"))
        assert abs(toxicity.scored(docs, one).first().score - want) < 1e-9
    assert toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).first().score < 1e-9


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = "".join(random.Random(4).choice("abcd ") for _ in range(5000))
    whole = toxicity.present([text, "", "ab", text[:100]])
    monkeypatch.setattr(toxicity, "AT_ONCE", 64)
    assert all((a == b).all() for a, b in zip(whole, toxicity.present([text, "", "ab", text[:100]]), strict=True))


def brute_spans(text):
    """The patterns as the contract words them, by plain regular expressions."""
    found = []
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15][kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789" * 2 + "..@@--  ()+aé%_\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_junk_is_read_in_linear_time():
    for junk in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1 " * 70_000, "a.b@" * 50_000):
        pii.base_spans(junk)


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    texts = []
    for i in range(300):
        kind = i % 6
        thing = [card(), f"+1 ({digits(3)}) 555-{digits(4)}", ".".join(str(rng.randint(1, 255)) for _ in range(4)), f"{digits(2)}@mail{digits(1)}.example.com", "version 3." + digits(1), digits(12)][kind]
        texts.append((i, f"some words before {thing} and after"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return pii.train(docs), card


def test_field_adds_what_the_patterns_lose(field):
    own, card = field
    a, b = card(), card()
    text = f"pay {a} {b} now"  # one match of 32 digits, which fails
    base, spans = pii.all_spans(text, own)
    assert base == [] and spans == [(2, 4, 20), (2, 21, 37)]
    text = "call +1 (826) 555-4081 190.137.223.20 ok"
    base, spans = pii.all_spans(text, own)
    assert [k for k, _, _ in base] == [1] and spans == [*base, (3, 5, 22)]
    for clean in ("version 3.0 of 2024", "the number 1234", "no digits", "", "a@b", "4111 1111 1111 1112"):
        assert pii.all_spans(clean, own) == ([], [])


def segmentations(n, spans):
    """All ways to lay some of the spans side by side, as lists."""
    if n == 0:
        return [[]]
    out = segmentations(n - 1, spans)
    return out + [rest + [x] for x in spans if x[1] == n for rest in segmentations(x[0], spans)]


def test_field_against_enumeration(field, monkeypatch):
    """The best segmentation, its posteriors, and the gradient of the likelihood, over all segmentations of short regions."""
    own, card = field
    rng = random.Random(4)
    for k in range(30):
        text = " " + rng.choice([f"{card()[:8]} 5", "+1 (555) 12", "1.2.3.4 7", "a1@b.cd 9", "12 34-5"])[: rng.randint(3, 11)] + " "
        lattice = pii.Lattice(text, 1, len(text) - 1)
        n = len(lattice)
        scores = {(i, j, kind): x for i in range(n) for j, s in own.scored(lattice, i) for kind, x in enumerate(s)}
        every = [(sum(scores[x] for x in seg), seg) for seg in segmentations(n, list(scores))]
        total = np.logaddexp.reduce([v for v, _ in every])
        best = max(every, key=lambda x: x[0])[1]
        want = []
        for x in best:
            if np.logaddexp.reduce([v for v, seg in every if x in seg]) - total >= np.log(pii.SURE):
                want.append((x[2], lattice.cuts[x[0]], lattice.cuts[x[1]]))
        for keep in (2000, 0):
            monkeypatch.setattr(pii, "KEEP", keep)
            assert own.best(lattice) == sorted(want, key=lambda x: x[1])


def test_training_raises_the_likelihood_of_the_spans():
    text = "\n12 34.5 6\n"
    gold = [(1, 1, 5)]
    trained = pii.train_field([(text, gold), ("\n12 34.5 7\n", [])], l2=0.01, steps=60)

    def log_likelihood(weights):
        total = 0.0
        for t, spans in ((text, gold), ("\n12 34.5 7\n", [])):
            lattice = pii.Lattice(t, 1, len(t) - 1)
            f = pii.Field(trained.names, weights)
            scores = {(i, j, k): x for i in range(len(lattice)) for j, s in f.scored(lattice, i) for k, x in enumerate(s)}
            place = {c: k for k, c in enumerate(lattice.cuts)}
            own = [(place[s], place[e], k) for k, s, e in spans if s in place and e in place]
            total += sum(scores[x] for x in own) - np.logaddexp.reduce([sum(scores[x] for x in seg) for seg in segmentations(len(lattice), list(scores))])
        return total - 0.005 * (weights**2).sum()

    at = log_likelihood(trained.weights)
    start = np.zeros_like(trained.weights)
    start[0] = -2
    assert at > log_likelihood(start) + 1
    rng = np.random.default_rng(0)
    for _ in range(20):  # near a maximum: no direction goes up by much
        step = rng.normal(size=trained.weights.shape) * 0.05
        assert log_likelihood(trained.weights + step) < at + 0.05


def test_long_regions_lose_no_candidate(field):
    own, card = field
    for k in range(0, 60):
        text = "(7) " * k + "+1 (826) 555-4081 190.137.223.20"
        found = pii.all_spans(text, own)[1]
        assert (3, 4 * k, 4 * k + 17) in found, k
    import time

    began = time.time()
    pii.all_spans("1 " * 20_000, own)
    assert time.time() - began < 30


def planted(rng, card):
    """A text with spans that the patterns lose, and where they are."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    phone, address = f"+1 ({digits(3)}) 555-{digits(4)}", ".".join(str(rng.randint(1, 255)) for _ in range(4))
    kind = rng.randrange(4)
    if kind == 0:
        a, b = card(), card()
        return f"pay {a} {b} now", {(2, 4, 20), (2, 21, 37)}
    if kind == 1:
        return f"call {phone} {address} ok", {(3, 5, 5 + len(phone))}
    if kind == 2:
        return f"version {rng.randint(1, 9)}.{rng.randint(0, 9)} of {digits(4)} and {digits(rng.choice([2, 5, 12]))}", set()
    return f"it costs {digits(2)}.{digits(2)} and {digits(3)} {digits(3)} a@b", set()


def test_precision_and_recall_of_added_spans(field):
    own, card = field
    rng = random.Random(12)
    right = wrong = missed = 0
    for _ in range(400):
        text, want = planted(rng, card)
        base, spans = pii.all_spans(text, own)
        added = set(spans) - set(base)
        right, wrong, missed = right + len(added & want), wrong + len(added - want), missed + len(want - set(spans))
    assert right / (right + wrong) >= 0.95 and right / (right + missed) >= 0.9, (right, wrong, missed)


def test_redacted_takes_overlapping_spans_as_one(spark, field):
    own, _ = field
    assert pii.all_spans("a +12.34.56.78 b", own)[0] == [(1, 3, 14), (3, 2, 14)]
    rows = spark.createDataFrame([(1, "a +12.34.56.78 b"), (2, "9.8.7.6 +12.34.56.78"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redacted(rows, own).collect()] == ["a <phone> b", "<ip> <phone>", None]


def test_spans_of(spark, field, odd_docs, no_docs):
    own, _ = field
    df, texts = odd_docs
    assert pii.spans_of(df, own).count() == len(texts) and pii.spans_of(no_docs, own).count() == 0
    rows = spark.createDataFrame([(1, "x 9.9.9.9 a@b.cd"), (2, None), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in pii.spans_of(rows, own).collect()}
    assert got == {(1, 1, 1, 0, 0, "email:10:16,ip:2:9"), (2, 0, 0, 0, 0, "")}
    assert [r.text for r in pii.redacted(rows, own).collect()] == ["x <ip> <email>", None, None]
    assert pii.redacted(df, own).columns == df.columns
    nothing = pii.train(no_docs)
    assert pii.all_spans("call +1 (826) 555-4081 190.137.223.20", nothing)[1] == [(1, 23, 37)]


@pytest.mark.parametrize(("cell", "block"), [(4000, 2000), (25, 40)])
def test_near_vectors(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(np.r_[x, x[:40] + rng.normal(size=(40, 6)) * 0.3, x[:20]].astype(np.float32))]
    odd = [None, [0.0] * 6, [1.0, None], [float("nan")] * 3, [], [1.0, 2.0], [2.0, 4.0], [float("inf"), 1.0]]
    rows += [(1000 + i, v, 4) for i, v in enumerate(odd)] + [(2000, [1.0, 2.0], None), (2001, [-0.0, 1.0], 5), (2002, [0.0, 1.0], 5)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), cell=cell).collect()}
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, la, a in ok:
        for j, lb, b in ok:
            if i < j and la == lb and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    assert sum(links.values()) > 60
    assert got == {i: (links[i], find(i), find(i) == i) for i, _, _ in rows}
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_without_an_id_and_extreme_ones(spark):
    rows = [(None, [1.0, 0.0], 1, 0), (None, [1.0, 0.0], 1, 0), (3, [1e-200, 0.0], 1, 0), (4, [1e200, 1e199], 1, 0), (5, [1.0, 0.0], 1, 0), (5, [1.0, 0.0], 1, 0), (6, [0.0, 5e-324], 1, 0), (7, [0.0, 1.0], 1, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, digest int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()), key=repr)
    assert got == sorted([(None, 0, None, True)] * 2 + [(3, 3, 3, True), (4, 3, 3, False), (5, 3, 3, False), (5, 3, 3, False), (6, 1, 6, True), (7, 1, 6, False)], key=repr)


def test_pipeline(spark, tmp_path, labelled, odd_docs):
    import corpus_pipeline

    _, labels, texts = labelled
    df, odd = odd_docs
    more = spark.createDataFrame([(5000 + i, t, "en", "s", len(t or ""), i, "k", None) for i, t in texts.items()], df.schema)
    df.union(more).write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("doc_id", labels.doc_id + 5000).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.collect()}
    assert not {5000 + i for i in range(0, 600, 5)} & ids  # toxic ones
    assert len({i for i in range(10, 50)} & ids) <= 1 and len({i for i in range(10, 100)} & ids) < 45  # copies, and near copies
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == ids


def test_memory_of_the_field_does_not_follow_long_tokens(spark):
    """Scores of long spans are not remembered, and a region that training collects is short."""
    field = pii.train_field([("\n+49 170 1234567\n", [(3, 1, 16)]), ("\na 12 b\n", [])])
    text = " ".join(str(i) * 3_000 for i in range(1, 40))
    pii.all_spans(text, field)
    assert sum(len(k[0]) for k in field.memo) <= pii.MEMO * pii.MEMO_CHARS
    assert max(map(lambda k: len(k[0]), field.memo), default=0) <= pii.MEMO_CHARS
    docs = spark.createDataFrame([(i, "9" * 200_000 + " " + "x@" * 100_000) for i in range(3)], "doc_id long, text string")
    kept = []
    original, pii.train_field = pii.train_field, lambda samples: kept.extend(samples) or original(samples)
    try:
        pii.train(docs)
    finally:
        pii.train_field = original
    assert kept
    assert max(len(region) for region, _ in kept) <= pii.REGION_CHARS + 2


def test_vectors_visit_few_cells_and_stay_floats(spark, monkeypatch):
    def never(*_):
        raise AssertionError("every label fits into a cell")

    monkeypatch.setattr(embeddings, "spherical_kmeans", never)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), i % 40) for i, v in enumerate(rng.normal(size=(400, 8)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert embeddings.near_vectors(df, cell=20).count() == 400
    assert {len(r.data) for r in embeddings.vectors(df, "vec_id", "embedding", "label").collect()} == {4 * 8}
