"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training reads a bounded sample of the labelled rows, whole texts. Presence of hashed n-grams is counted by class; the
n-grams whose counts tell the classes apart best become features, each scaled by its log-count ratio, and logistic
regression weighs them. Scoring is one pass over all texts with a table of weights of fixed size, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import plain_docs, released, scratch, slices, table, tidy, written

#: Labelled rows that training reads at most: those that a hash of their id puts first.
SAMPLE = 12_000
SIZES = (3, 4, 5, 6)
BITS = 20
FEATURES = 2_048
#: Rows of a class that an n-gram must occur in.
LEAST = 3
THRESHOLD = 0.3
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


#: Characters that are hashed at once; longer texts are read in parts, which bounds memory.
AT_ONCE = 1 << 18


def buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the hashed n-grams of all texts, and the text that each lies in (-1: it crosses two)."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter(map(len, texts), np.int64, len(texts)))
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, max(SIZES) + 1):
        m = len(chars) - n + 1
        if m <= 0:
            return
        h = h[:m] + chars[n - 1 :] * _K[n - 1]
        if n in SIZES:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            inside = owner[:m] == owner[n - 1 :]
            yield (mixed >> np.uint64(64 - BITS)).astype(np.int64), np.where(inside, owner[:m], -1)


def _parts(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Groups of lower-cased texts, or of overlapping parts of long ones, with about AT_ONCE characters, and their texts."""
    group, own, size = [], [], 0
    for k, text in enumerate(texts):
        text = text.lower()
        for at in range(0, max(1, len(text)), AT_ONCE):
            group.append(text[at : at + AT_ONCE + max(SIZES) - 1])
            own.append(k)
            size += len(group[-1])
            if size >= AT_ONCE:
                yield group, own
                group, own, size = [], [], 0
    if group:
        yield group, own


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of text and bucket; only buckets where `wanted` is set, if given."""
    found = [np.zeros(0, np.int64)]
    for group, own in _parts(texts):
        place = np.array(own, np.int64)
        for b, owner in buckets(group):
            keep = np.flatnonzero(owner >= 0 if wanted is None else wanted[b] & (owner >= 0))
            found.append(np.unique((place[owner[keep]] << BITS) | b[keep]))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n_cols: int, l2: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept of L2-regularised logistic regression on a sparse matrix, by L-BFGS."""
    n = len(y)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(rows, vals * w[cols], n) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        value = np.logaddexp(0, z).sum() - (y * z).sum() + l2 / 2 * (w[:-1] ** 2).sum()
        e = p - y
        return value, np.r_[np.bincount(cols, vals * e[rows], n_cols) + l2 * w[:-1], e.sum()]

    w = np.zeros(n_cols + 1)
    w[-1] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, d in reversed(past):
            a = (s @ q) / (s @ d)
            q -= a * d
            alphas.append(a)
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(grad))
        for (s, d), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (d @ q) / (s @ d))
        step, slope = 1.0, grad @ q
        while step > 1e-8:
            new = w - step * q
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (new - w) @ (new_grad - grad) > 1e-12:
            past = [*past[-9:], (new - w, new_grad - grad)]
        done = value - new_value < 1e-6 * abs(value)
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w[:-1], float(w[-1])


class Model:
    """weights: one number for each bucket, 0 for most."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, b = present(texts, self.weights != 0)
        z = self.bias + np.bincount(rows, self.weights[b], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model of the rows of `labels` (doc_id, toxic) outside the held-out fold. Of several labels of one document the
    largest counts; null labels do not. Without both classes every score is the share of toxic rows (0 without rows)."""
    with scratch(docs.sparkSession):
        return _train(docs, labels, sample, features, doc_id, text)


def _train(docs: DataFrame, labels: DataFrame, sample: int, features: int, doc_id: str, text: str) -> Model:
    spark = docs.sparkSession
    chosen = labels.filter(F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = plain_docs(docs, doc_id, text).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # `sample` ids at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                y = part.column("toxic").to_numpy() > 0
                owner, b = present(texts.to_pylist())
                for k in (0, 1):
                    np.add.at(total[k], b[y[owner] == k], 1)
                    n[k] += (y == k).sum()
        seen = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen], pa.int64()), pa.array(np.r_[n[0], total[0][seen]], pa.int64()), pa.array(np.r_[n[1], total[1][seen]], pa.int64())], ["bucket", "clean", "toxic"])

    counts = rows.mapInArrow(tidy(count), "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(spark, counts.filter(F.greatest("clean", "toxic") >= LEAST), "ngrams")
    sums = counts.groupBy(F.col("bucket") < 0).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()
    whole = {r[0]: r for r in sums}  # of the rows, and of all n-grams
    n0, n1 = (whole[True].clean, whole[True].toxic) if True in whole else (0, 0)
    if not n0 or not n1 or False not in whole:
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(n1 / n0)) if n0 and n1 else 500.0 if n1 else -500.0)
    p, q = F.col("toxic") + 1.0, F.col("clean") + 1.0
    both = (p + q) / (n0 + n1 + 4)
    # Log-likelihood ratio of presence against class: how well an n-gram tells the classes apart.
    part = lambda k, m: k * F.log(k / (m + 2) / both) + (m + 2 - k) * F.log((1 - k / (m + 2) + 1e-12) / (1 - both + 1e-12))
    best = counts.filter("bucket >= 0").withColumn("gain", part(p, n1) + part(q, n0)).orderBy(F.desc("gain"), "bucket").limit(features).toPandas()
    names = best.bucket.to_numpy()
    ratio = np.log((best.toxic + 1.0) / (whole[False].toxic + whole[False].n)) - np.log((best.clean + 1.0) / (whole[False].clean + whole[False].n))
    ratio = ratio.to_numpy()
    index = np.full(1 << BITS, -1, np.int32)
    index[names] = np.arange(len(names))
    shared = spark.sparkContext.broadcast(index)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                owner, b = present(texts.to_pylist(), shared.value >= 0)
                at = shared.value[b]
                cut = np.split(at, np.searchsorted(owner, np.arange(1, len(texts))))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(cut, pa.list_(pa.int32()))], ["toxic", "cols"])

    found = rows.mapInArrow(tidy(vectors), "toxic int, cols array<int>").toArrow()  # `sample` rows of `features` numbers at most
    y = (found.column("toxic").to_numpy() > 0).astype(float)
    lists = found.column("cols").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    cols = lists.values.to_numpy()[lists.offsets[0].as_py() :]
    del found, lists
    w, bias = fit_logistic(np.repeat(np.arange(len(y)), sizes), cols, ratio[cols], y, len(names))
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = w * ratio
    del cols, sizes
    released()  # of the driver
    return Model(weights, bias)


def cross_validated(docs: DataFrame, labels: DataFrame, options: Sequence[int], sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """For each number of features: log loss, precision and recall at THRESHOLD over the labelled rows outside the held-out
    fold, each scored by a model that has not seen its third of them. FEATURES was chosen by this, by log loss; the
    held-out rows play no part in it."""
    plain = labels.filter(F.col("toxic").isNotNull() & ~held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4  # 0, 1 or 3
    out = []
    for n in options:
        parts = None
        for k in (0, 1, 3):
            model = train(docs, plain.filter(third != k), sample, n, doc_id, text)
            chosen = F.broadcast(plain.filter(third == k).select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(sample))  # `sample` ids at most
            own = scored(plain_docs(docs, doc_id, text).join(chosen, "doc_id", "left_semi"), model).join(plain, "doc_id")
            parts = own if parts is None else parts.unionByName(own)
        p, y, hit = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score"))), F.col("toxic") == 1, F.col("score") >= THRESHOLD
        row = parts.agg(F.avg(-F.log(F.when(y, p).otherwise(1 - p))).alias("loss"), (F.count_if(y & hit) / F.count_if(hit)).alias("precision"), (F.count_if(y & hit) / F.count_if(y)).alias("recall")).first()
        out.append({"features": n, **row.asDict()})
    return out


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of each row; a null text counts as empty, and an empty text scores as the intercept says. Repeated
    rows and rows with a null doc_id stay; other columns are ignored; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(texts.to_pylist()), pa.float64())], ["doc_id", "score"])

    return plain_docs(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of `docs` that score under `threshold`, with all their columns; texts are scored where they are read. A null
    text counts as empty; repeated rows share a score; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            named = pa.RecordBatch.from_arrays([texts, pa.array(np.arange(len(texts)))], ["text", "row"])
            score = np.zeros(len(texts))
            for part, own in slices(named, "text"):
                score[part.column("row").to_numpy()] = shared.value.scores(own.to_pylist())
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
