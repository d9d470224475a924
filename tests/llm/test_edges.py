"""Repeated rows, null ids, clashing names and empty tables for every operator; the classifier against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, embeddings, exact_dedup, jaccard, packing, pii, substrings, token_counts, token_output, toxicity
from tidemark.llm.chunks import vocabulary_path

BYTE, WORD = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")
PASSAGE = " ".join(f"w{i}" for i in range(30))
TEXTS = [(1, "one two 1.2.3.4 a@b.cd"), (1, "one two 1.2.3.4 a@b.cd"), (2, None), (2, ""), (None, "no id, " + PASSAGE), (None, None), (3, PASSAGE), (3, PASSAGE), (4, "x " + PASSAGE)]


@pytest.fixture(scope="module")
def rows(spark):
    """Ids that repeat with one text and with several, ids that are null, and columns named like those used inside."""
    schema = "doc_id long, text string, ids string, score double, keys string, spans string, edge string, key string, words string, _row string, _text string, n_tokens string"
    return spark.createDataFrame([(i, t, *["x", 0.5, *["y"] * 8]) for i, t in TEXTS], schema).repartition(2)


def bag(found):
    return collections.Counter(tuple(r) for r in found)


def per_row(f):
    return collections.Counter((i, *f(t or "")) for i, t in TEXTS)


def test_row_by_row_operators(rows):
    library = Tokenizer.from_file(BYTE)
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert bag(bpe.round_trip(rows, BYTE).collect()) == per_row(lambda t: (len(ids(t)), digest(",".join(map(str, ids(t)))), digest(t)))
    assert bag(token_counts.token_counts(rows, BYTE).collect()) == per_row(lambda t: (len(t.encode()), len(ids(t)), False))
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), 0.0)
    assert bag(toxicity.scored(rows, model).collect()) == per_row(lambda t: (0.5,))
    assert bag(toxicity.without_toxic(rows, model, 0.6).select("doc_id", "text").collect()) == collections.Counter(TEXTS)
    assert toxicity.without_toxic(rows, model, 0.4).count() == 0
    field = pii.train(rows.limit(0))
    assert bag(pii.spans_of(rows, field).select("doc_id", "n_email", "n_ip").collect()) == per_row(lambda t: (t.count("@"), t.count("1.2.3.4")))
    assert bag((r.text,) for r in pii.redacted(rows, field).collect()) == collections.Counter((t if t is None else t.replace("1.2.3.4", "<ip>").replace("a@b.cd", "<email>"),) for _, t in TEXTS)


def test_token_files(spark, rows, tmp_path):
    library = Tokenizer.from_file(BYTE)
    token_output.write_tokens(rows, str(tmp_path / "t"), BYTE)
    found = token_output.read_tokens(spark, str(tmp_path / "t")).collect()
    want = collections.Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in TEXTS)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))


def test_packing(rows):
    library = Tokenizer.from_file(WORD)
    found = packing.packed(rows, WORD).collect()
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0) == collections.Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in TEXTS)
    assert sum(r.length for r in found) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)


def test_repeats_of_rows_with_one_id(rows):
    """Rows are ordered by id, null last, and each is a document of its own."""
    got = bag((r.doc_id, r.n_words, r.n_removed) for r in substrings.without_repeats(rows).collect())
    want = collections.Counter((i, len((t or "").split()), 30 if i in (4, None) and t else 0) for i, t in TEXTS if i != 3)
    assert got == want + collections.Counter({(3, 30, 0): 1, (3, 30, 30): 1})


def test_copies_with_clashing_names(rows):
    assert bag((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(rows).collect()) == collections.Counter({(1, 1, 2): 2, (2, 2, 3): 2, (None, 2, 3): 1, (None, None, 1): 1, (3, 3, 2): 2, (4, 4, 1): 1})
    kept = exact_dedup.drop_exact_copies(rows)
    assert kept.columns == rows.columns and bag(kept.select("doc_id").collect()) == collections.Counter({(1,): 2, (2,): 2, (3,): 2, (4,): 1, (None,): 1})
    one = jaccard.one_of_each(rows, 5, 80)
    assert one.columns == rows.columns and one.filter("text LIKE '%w1 %'").count() == 1 and one.filter("text IS NULL OR text = ''").count() == 3
    got = bag((r.doc_id, r.component_id) for r in jaccard.near_groups(rows, 5, 80).collect())
    assert got == collections.Counter({(1, 1): 2, (2, 2): 2, (3, 3): 2, (4, 3): 1, (None, None): 2})


def test_vectors_with_repeats_and_clashing_names(spark):
    data = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [1.0, 0.0], None)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in data], "vec_id long, embedding array<double>, label int, id string, place string, digest string")
    got = bag(embeddings.near_vectors(df).collect())
    assert got == collections.Counter({(1, 2, 1, True): 2, (2, 2, 1, False): 1, (None, 0, None, True): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 1, (5, 0, 5, True): 1, (6, 0, 6, True): 1})


def test_an_empty_table_passes_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_odd_rows(spark, tmp_path):
    import corpus_pipeline

    texts = [(i, t, "en", "s", 0) for i, t in TEXTS] + [(100 + i, f"clean words number {i} " * 5, "en", "s", 0) for i in range(40)] + [(200 + i, f"vile grumfek {i} and more", "en", "s", 0) for i in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(200 + i, 0, 1) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in found}
    assert not ids & set(range(200, 220)) and {1, 2, 3, None} & ids == {1, 2, 3} or ids >= {1, 2, 3}


def test_ratios_and_scores_by_brute_force(spark):
    """Presence of every n-gram counted one by one, its log-count ratio, and the scores that the weights give."""
    texts = [(i, f"{'bad' if i % 3 == 0 else 'fine'} word{i % 5} {'Grum' * (i % 3 == 0)}") for i in range(90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, features=12)
    used = {r.doc_id for r in labels.filter(~toxicity.held_out("doc_id")).collect()}
    assert 40 < len(used) < 90

    def grams(text):
        low = text.lower()
        return {next(int(b[0]) for b, _ in [x for x in toxicity.buckets([low[k : k + n]])][-1:]) for n in toxicity.SIZES for k in range(len(low) - n + 1)}

    sets = {i: grams(t) for i, t in texts}
    total = {y: sum(1 for i in used if (i % 3 == 0) == y) for y in (True, False)}
    seen = {y: collections.Counter(b for i in used if (i % 3 == 0) == y for b in sets[i]) for y in (True, False)}
    every = [b for b in {*seen[True], *seen[False]} if max(seen[True][b], seen[False][b]) >= toxicity.LEAST]
    mass = {y: sum(seen[y][b] + 1 for b in every) for y in (True, False)}

    def gain(b):
        p, q, n1, n0 = seen[True][b] + 1, seen[False][b] + 1, total[True], total[False]
        both = (p + q) / (n0 + n1 + 4)
        part = lambda k, m: k * np.log(k / (m + 2) / both) + (m + 2 - k) * np.log((1 - k / (m + 2) + 1e-12) / (1 - both + 1e-12))
        return part(p, n1) + part(q, n0)

    best = sorted(every, key=lambda b: (-round(gain(b), 9), b))[:12]
    chosen = np.flatnonzero(model.weights)
    assert set(chosen) <= set(every) and abs(sum(map(gain, best)) - sum(map(gain, chosen))) < 1e-6
    ratio = {b: np.log((seen[True][b] + 1) / mass[True]) - np.log((seen[False][b] + 1) / mass[False]) for b in chosen}
    # The weights are those of a logistic regression on presence times ratio: its gradient vanishes there.
    x = np.array([[ratio[b] * (b in sets[i]) for b in chosen] for i in sorted(used)])
    y = np.array([float(i % 3 == 0) for i in sorted(used)])
    w = np.array([model.weights[b] / ratio[b] for b in chosen])
    error = 1 / (1 + np.exp(-(x @ w + model.bias))) - y
    assert np.abs(x.T @ error + w).max() < 0.05 and abs(error.sum()) < 0.05
    for r in toxicity.scored(docs, model).collect():
        z = model.bias + sum(model.weights[b] for b in sets[r.doc_id] if b in ratio)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-5


def test_cross_validation_reads_no_held_out_row(spark):
    texts = [(i, f"{'bad' if i % 3 == 0 else 'fine'} word{i % 5}") for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id long, toxic int")
    got = toxicity.cross_validated(docs, labels, [8])[0]
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert got["recall"] == got["precision"] == 1 and got == toxicity.cross_validated(docs, wrong, [8])[0]
