"""Personal data: patterns, and a semi-Markov conditional random field that adds spans which the patterns miss.

The patterns' spans always stay. The field looks at the rest of the regions that hold a digit or an at sign. A region is
a row of tokens (digits, letters, or one other character); every run of up to `LONGEST` tokens is a candidate of every
kind, scored on features of the whole span, and dynamic programming chooses boundaries and kinds jointly. It is trained
on the patterns' own spans in a bounded sample of regions, without features of a leading plus sign, so that it learns
the shapes of what the patterns know; a span is added where the field's posterior is at least `SURE`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import plain_docs, released, slices, table, tidy

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a candidate span at most, which bounds the work for each token of a region.
LONGEST = 20
#: Bounds of training: regions that it reads, and tokens and characters of a region (longer ones are cut; only in training).
SAMPLE, REGION, REGION_CHARS = 1_500, 40, 1_000
#: Candidates whose scores a worker remembers at most, and characters of those that it remembers.
MEMO, MEMO_CHARS = 20_000, 64
#: Tokens of a region up to which the scores of all candidates are kept between the two passes over it.
KEEP = 2_000
SURE = 0.95

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, which the looking back says without changing what is found.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]")
TRIGGER = re.compile("[0-9@]")
NEAR = re.compile(r"[0-9+(][0-9+().\x20-]*|[^\s@]*@[^\s]*")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """What the patterns find, leftmost and without overlap in each kind, in the order of kind and start."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if TRIGGER.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                found.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                found.append((2, m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text that may hold a span: around digits and at signs."""
    if TRIGGER.search(text):
        for m in NEAR.finditer(text):
            if TRIGGER.search(m[0]):
                yield m.start(), m.end()


class Lattice:
    """Tokens of a region and the features of its candidates."""

    def __init__(self, text: str, start: int, end: int, most: int | None = None):
        self.cuts = [start, *(m.end() for m in islice(TOKEN.finditer(text, start, end), most))]
        self.text = text

    def __len__(self) -> int:
        return len(self.cuts) - 1

    def ends(self, i: int) -> Iterator[int]:
        """The tokens after the last of the candidates that begin with token i."""
        if not self.text[self.cuts[i]].isspace():
            for j in range(i + 1, min(len(self), i + LONGEST) + 1):
                if not self.text[self.cuts[j] - 1].isspace():
                    yield j

    def seen(self, i: int, j: int) -> tuple[str, str, str]:
        """What the features of a candidate depend on: the span, and the character before and after it."""
        a, b = self.cuts[i], self.cuts[j]
        return self.text[a:b], self.text[max(0, a - 1) : a], self.text[b : b + 1]


def _class(c: str) -> str:
    return "" if not c else "0" if c in "0123456789" else "a" if c.isalpha() else " " if c.isspace() else c if c in "@.-+()" else "?"


def features(span: str, left: str, right: str) -> list[str]:
    """Of a whole span; a leading plus sign is left out of account."""
    span = span.removeprefix("+")
    digits = NOT_DIGIT.sub("", span)
    n, parts = len(digits), span.split(".")
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", lambda m: str(min(len(m[0]), 20)), span))
    found = ["bias", f"n{n if n < 21 else 21}", f"shape{shape[:40]}", f"in{_class(span[:1])}{_class(span[-1:])}", f"left{_class(left)}", f"right{_class(right)}"]
    if n >= 13:
        found.append(f"luhn{int(n < 20 and luhn(digits))}{min(n, 20)}")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        found.append(f"quad{int(all(len(p) < 4 and int(p) <= 255 for p in parts))}")
    if "@" in span:
        local, _, domain = span.partition("@")
        well = bool(local) and "@" not in domain and all(c in LOCAL for c in local) and re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*", domain) is not None
        found.append(f"at{int(well)}{min(2, domain.count('.'))}")
    else:
        found.append(f"mix{int(any(c.isalpha() for c in span))}{int('(' in span)}{int('-' in span)}{int(' ' in span)}{int(len(parts) > 1)}")
    return found


class Field:
    """Weights of (feature, kind); unknown features weigh nothing, a span with an unknown shape loses what training says."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights
        self.memo: dict[tuple[str, str, str], np.ndarray] = {}

    def scored(self, lattice: Lattice, i: int) -> list[tuple[int, np.ndarray]]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        return [(j, self._score(*lattice.seen(i, j))) for j in lattice.ends(i)]

    def _score(self, *seen: str) -> np.ndarray:
        found = self.memo.get(seen)
        if found is None:
            found = self.weights[[k for f in features(*seen) if (k := self.names.get(f)) is not None] or [0]].sum(0)
            if len(seen[0]) <= MEMO_CHARS:
                self.memo[seen] = found
        return found

    def best(self, lattice: Lattice) -> list[Span]:
        """The best segmentation's spans whose posterior is at least SURE, in characters of the text.

        The whole region is read, however long: one pass from its end sums over what follows each token, one from its
        start chooses. Only numbers per token stay between them, or the scores too where the region is short.
        """
        n = len(lattice)
        kept = [self.scored(lattice, i) for i in range(n)] if n <= KEEP else None
        scored = kept.__getitem__ if kept is not None else lambda i: self.scored(lattice, i)
        behind = np.zeros(n + 1)  # log sums over all segmentations of what follows
        for i in range(n - 1, -1, -1):
            terms = [behind[i + 1], *(behind[j] + x for j, s in scored(i) for x in s)]
            behind[i] = np.logaddexp.reduce(terms)
        top, ahead = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        top[0] = ahead[0] = 0
        back: list[tuple[int, int, float]] = [(-1, -1, 0.0)] * (n + 1)  # first token, kind, log posterior
        for i in range(n):
            if top[i] >= top[i + 1]:
                top[i + 1], back[i + 1] = top[i], (-1, -1, 0.0)
            ahead[i + 1] = np.logaddexp(ahead[i + 1], ahead[i])
            for j, s in scored(i):
                kind = int(s.argmax())
                ahead[j] = np.logaddexp(ahead[j], ahead[i] + np.logaddexp.reduce(s))
                if top[i] + s[kind] > top[j]:
                    top[j], back[j] = top[i] + s[kind], (i, kind, ahead[i] + s[kind] + behind[j] - behind[0])
        found, j = [], n
        while j > 0:
            i, kind, posterior = back[j]
            if i < 0:
                j -= 1
                continue
            if posterior >= np.log(SURE):
                found.append((kind, lattice.cuts[i], lattice.cuts[j]))
            j = i
        return found[::-1]


def train_field(samples: list[tuple[str, list[Span]]], l2: float = 0.05, steps: int = 40) -> Field:
    """samples: regions with a character of context on either side, and their spans. Maximises the likelihood of the
    spans over all segmentations, by gradient steps of adaptive size on all regions at once."""
    seen: dict[str, int] = {}
    rows = []
    for text, spans in samples:
        lattice = Lattice(text, 1, len(text) - 1, REGION)
        place = {c: k for k, c in enumerate(lattice.cuts)}
        gold = {(place[s], place[e]): k for k, s, e in sorted(spans, reverse=True) if s in place and e in place}
        rows.append((len(lattice), [(i, j, features(*lattice.seen(i, j))) for i in range(len(lattice)) for j in lattice.ends(i)], gold))
        for _, _, fs in rows[-1][1]:
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
    names = {"bias": 0} | {f: k for k, f in enumerate(sorted(f for f in seen if seen[f] > 1 and f != "bias"), 1)}
    width = max(len(f) for _, cs, _ in rows for _, _, f in cs) if any(r[1] for r in rows) else 1
    region, first, last, feats, target = [], [], [], [], []
    for r, (_, cs, gold) in enumerate(rows):
        for i, j, fs in cs:
            ks = [names[f] for f in fs if f in names]
            region.append(r)
            first.append(i)
            last.append(j)
            feats.append(ks + [len(names)] * (width - len(ks)))
            target.append(gold.get((i, j), -1))
    if not region:
        return Field({"bias": 0}, np.full((1, len(KINDS)), -10.0))
    region, first, last, target = map(np.array, (region, first, last, target))
    feats = np.array(feats)
    lengths = np.array([r[0] for r in rows])
    at_end = [np.flatnonzero(last == j) for j in range(REGION + 1)]
    at_start = [np.flatnonzero(first == i) for i in range(REGION + 1)]
    known = np.zeros((len(names) + 1, len(KINDS)))
    hit = np.flatnonzero(target >= 0)
    np.add.at(known, (feats[hit].ravel(), np.repeat(target[hit], width)), 1)
    w, m, v = np.zeros((len(names) + 1, len(KINDS))), 0.0, 0.0
    w[0] = -2.0
    for t in range(1, steps + 1):
        s = w[feats].sum(1)
        total = np.logaddexp.reduce(s, 1)
        ahead, behind = np.zeros((len(rows), REGION + 1)), np.zeros((len(rows), REGION + 1))
        for j in range(1, REGION + 1):
            ahead[:, j] = ahead[:, j - 1]
            c = at_end[j]
            np.logaddexp.at(ahead[:, j], region[c], ahead[region[c], first[c]] + total[c])
        for i in range(REGION - 1, -1, -1):
            behind[:, i] = np.where(i < lengths, behind[:, i + 1], 0)
            c = at_start[i]
            np.logaddexp.at(behind[:, i], region[c], behind[region[c], last[c]] + total[c])
        whole = ahead[np.arange(len(rows)), lengths]
        p = np.exp(ahead[region, first][:, None] + s + behind[region, last][:, None] - whole[region][:, None])
        grad = l2 * w - known
        for k in range(width):
            np.add.at(grad, feats[:, k], p)
        grad[-1] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w - 0.4 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w[-1] = 0
    return Field(names, w[:-1])


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """From `sample` regions at most, of `sample` documents at most: of the documents with a digit or an at sign, those
    that a hash of their id puts first, and of all their regions those that a hash of theirs puts first. A region is cut
    after `REGION` tokens or `REGION_CHARS` characters here. Without any region, the field adds nothing."""
    rows = plain_docs(docs, doc_id, text).filter(F.col("text").rlike("[0-9@]"))
    chosen = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    rows = rows.join(F.broadcast(chosen), "doc_id")  # `sample` ids at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, "text"):
                found = []
                for t in texts.to_pylist():
                    spans = base_spans(t)
                    for a, b in regions(t):
                        b = Lattice(t, a, min(b, a + REGION_CHARS), REGION).cuts[-1]
                        own = [f"{k}:{s - a + 1}:{e - a + 1}" for k, s, e in spans if a <= s and e <= b]
                        found.append(((t[a - 1] if a else "\n") + t[a:b] + (t[b] if b < len(t) else "\n"), ",".join(own)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["region", "spans"])

    found = rows.mapInArrow(tidy(cut), "region string, spans string").orderBy(F.xxhash64("region"), "region").limit(sample).collect()
    field = train_field([(r.region, [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]) for r in found])
    released()  # of the driver
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all spans with those that the field adds; no added span overlaps another."""
    base = base_spans(text)
    added: list[Span] = []
    taken = sorted((s, e) for _, s, e in base)
    for a, b in regions(text):
        for start, end in _gaps(a, b, taken):
            if TRIGGER.search(text, start, end):
                added += field.best(Lattice(text, start, end))
    return base, sorted(base + added)


def _gaps(a: int, b: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for s, e in taken:
        if e > a and s < b:
            if s > a:
                yield a, s
            a = max(a, e)
    if a < b:
        yield a, b


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def spans_of(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, number of the patterns' spans of each kind, base_sha256, spans (all), n_added.

    A null text counts as empty and has no spans. Repeated rows and rows with a null doc_id stay; other columns are
    ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text"):
                counts, digest, joined, added = [], [], [], []
                for t in texts.to_pylist():
                    base, spans = all_spans(t, shared.value)
                    counts.append([sum(x[0] == k for x in base) for k in range(len(KINDS))])
                    digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    joined.append(_joined(spans))
                    added.append(len(spans) - len(base))
                numbers = np.array(counts, np.int64).reshape(-1, len(KINDS))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(numbers[:, k]) for k in range(len(KINDS))), pa.array(digest, pa.string()), pa.array(joined, pa.string()), pa.array(added, pa.int64())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    return plain_docs(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """`docs` with each span, and spans that overlap as one, replaced by its kind in angle brackets. A null text stays
    null; all other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text)

    def clean(t: str) -> str:
        out, last = [], 0
        for s, e, k in sorted((s, e, k) for k, s, e in all_spans(t, shared.value)[1]):
            if s >= last:
                out += [t[last:s], f"<{KINDS[k]}>"]
            last = max(last, e)
        return "".join(out) + t[last:] if out else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(at), pa.string())
            new = pa.array([None if t is None else clean(t) for t in texts.to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.field(at).name, new.cast(batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans_of(docs, train(docs))
