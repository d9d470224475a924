"""Tokenizer operators against the tokenizers library, and packing."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, chunks, packing, token_counts, token_output
from tidemark.llm.chunks import library_encoder, vocabulary_path

BYTE, WORD = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(1)
    alphabet = "ab 'ts\n\t ́é1-._<|>\x1c\0Σ　The"
    return ["", " ", "a  b", "\n\n a\n", "x <|endoftext|> y", "<|endoftext|><|endoftext|>", "a" * 500, "ab" * 300, "I'm don't 'S", "a\n ", "x\n  y"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def ids_of(chunked, texts):
    ids, sizes = chunked.batch(texts)
    assert len(sizes) == len(texts) and sizes.sum() == len(ids)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_give_the_librarys_ids(path, monkeypatch):
    texts = odd_texts()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    own = library_encoder(path)
    assert ids_of(own, texts) == want
    own.most = own.core = 10  # a memo that starts anew
    assert ids_of(own, texts) == ids_of(own, texts) == want
    for at_once, ids in ((1, 1 << 22), (50, 100), (1 << 18, 100)):
        monkeypatch.setattr(chunks, "AT_ONCE", at_once)
        monkeypatch.setattr(chunks, "MEMO_IDS", ids)
        assert ids_of(own, texts) == want
    assert own.batch([])[0].tolist() == own.batch([""])[0].tolist() == []


def test_chunks_of_one_hash_slot_are_told_apart():
    memo, rng = chunks.Memo(), np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 40, 20_000, dtype=np.uint64) << np.uint64(12), rng.integers(0, 4, 20_000, dtype=np.uint64)
    pairs = np.unique(np.stack([a // np.uint64(8) * np.uint64(8), b], 1), axis=0)  # many share their low bits
    for part in np.array_split(pairs, 7):
        memo.add(part[:, 0], part[:, 1], np.ones(len(part), np.int64), part[:, 1])
    assert memo.find(pairs[:, 0], pairs[:, 1]).tolist() == list(range(len(pairs)))
    assert (memo.find(pairs[:, 0], pairs[:, 1] + np.uint64(9)) == -1).all()
    memo.shrink(100)
    assert memo.find(pairs[:, 0], pairs[:, 1]).tolist() == [*range(100), *[-1] * (len(pairs) - 100)]


def test_keys_tell_long_chunks_apart():
    rng = random.Random(7)
    words = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(5000)}
    words |= {w[:-1] + b"c" for w in words} | {b"c" + w for w in words}
    sizes = np.array(list(map(len, words)))
    data = np.frombuffer(b"".join(words) + b"\0" * 8, np.uint8)
    a, b = chunks.keys(data, np.cumsum(sizes) - sizes, sizes)
    assert len(set(a.tolist())) == len(set(b.tolist())) == len(words)


def texts_of_all_characters():
    """Every assigned character in every place of a chunk, some at a time; those that send a text to the library alone."""
    shown = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    odd = [c for c in shown if c < " " or c.isspace()] + [".", "'", "é", "\u0301"]
    forms = lambda c: f"a{c}. {c}, {c}b! {c} e{c}e\n{c}a\na{c}) x{c}{c}"
    shown = sorted(set(shown) - set(odd))
    return [" ".join(map(forms, shown[k : k + 50])) for k in range(0, len(shown), 50)] + [forms(c) for c in odd] + [f"a{c}{d}b {c} {d}\n{c}x" for c in odd for d in odd]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_all_characters(path):
    texts = texts_of_all_characters()
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    wrong = lambda found: [k for k, (a, b) in enumerate(zip(found, want, strict=True)) if a != b]
    assert wrong(ids_of(library_encoder(path), texts)) == []
    if path == BYTE:
        assert wrong(bpe.Codec(path).encode(texts)) == []
        assert token_counts.Counter(path).batch(texts).tolist() == list(map(len, want))


@pytest.mark.parametrize("text", ["\u0130.", "D\u0130YARBAKIRDAK\u0130. Son", "\u0958, x", "x\u095f!\n\u0130"])
def test_letters_that_end_in_a_mark_when_normalised(text):
    assert library_encoder(WORD).batch([text])[0].tolist() == Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids


def test_a_memo_shrinks_when_a_task_ends(monkeypatch):
    monkeypatch.setattr(chunks, "REST", 100)
    own = library_encoder(WORD)
    with own.task():
        own.batch([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)), "z" * 5000])
        assert own.memo.n > 300
    assert own.memo.n == 100


def test_codec_and_counts():
    texts, library = odd_texts(), Tokenizer.from_file(BYTE)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    own = bpe.Codec(BYTE)
    assert own.encode(texts) == want
    assert [own.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    assert token_counts.Counter(BYTE).batch(texts).tolist() == [len(x) for x in want]


def test_long_words_merge_as_short_ones():
    v, rng = bpe.Vocabulary(BYTE), random.Random(2)
    for _ in range(50):
        ids = [v.byte_ids[rng.choice(b"abthe ")] for _ in range(rng.randint(1, 300))]
        assert bpe.merge_long(list(ids), v.merges) == bpe.merge_short(list(ids), v.merges)


def test_encoding_operators(spark, odd_docs, no_docs):
    df, texts = odd_docs
    library = Tokenizer.from_file(BYTE)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    assert {r.doc_id: r.ids for r in bpe.encoded(df, BYTE).collect()} == want
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df, BYTE), BYTE).collect()}
    assert back == {i: library.decode(x, skip_special_tokens=False) for i, x in want.items()}
    for r in bpe.round_trip(df, BYTE).collect():
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(back[r.doc_id].encode()).hexdigest()
    sizes = {i: len((t or "").encode()) for i, t in texts}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, BYTE).collect()} == {i: (sizes[i], len(x), len(x) > 512) for i, x in want.items()}
    for f in (bpe.encoded, bpe.round_trip, token_counts.token_counts):
        assert f(no_docs, BYTE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 300, 60_000])
def test_code(n):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(1, n) * 100).astype(np.int64) + 1
    lengths = token_output.code_lengths(counts)
    assert lengths.max(initial=0) <= token_output.LONGEST
    assert sum(2.0 ** -int(x) for x in lengths if x) == (0 if n == 0 else 0.5 if n == 1 else 1)
    if n:
        ids, sizes = rng.integers(0, n, 5000), np.array([0, 1, 255, 256, 257, 0, 1000, 3231])
        code = token_output.Code(lengths)
        assert (code.decode(*code.encode(ids, sizes), sizes) == ids).all()


def test_short_limit_is_optimal_where_it_does_not_bind():
    counts = np.array([1, 1, 2, 4, 8, 16, 0, 32])
    assert token_output.code_lengths(counts).tolist() == [6, 6, 5, 4, 3, 2, 0, 1]
    assert token_output.code_lengths(counts, 3).max() == 3


def test_files(spark, odd_docs, no_docs, tmp_path):
    df, texts = odd_docs
    library = Tokenizer.from_file(BYTE)
    token_output.write_tokens(df, str(tmp_path / "a"), BYTE)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids) for r in token_output.read_tokens(spark, str(tmp_path / "a")).collect()}
    crc = {r.doc_id: r.ids_crc32 for r in token_output.read_tokens(spark, str(tmp_path / "a"), digest=True).collect()}
    start = 0
    for i, t in sorted(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (start, len(ids), ids)
        assert crc[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_output.write_tokens(no_docs, str(tmp_path / "b"), BYTE)
    assert token_output.read_tokens(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("most_open", [512, 3])
def test_packer(most_open):
    rng = random.Random(most_open)
    packer, windows, docs = packing.Packer(64, most_open), [], {}
    for i in range(500):
        docs[i] = np.arange(rng.choice([0, 1, 5, 33, 40, 63, 64, 65, 200])).astype("<u4").tobytes()
        windows += packer.put(i, docs[i])
        assert packer.n_open <= most_open
    windows += packer.finish()
    sizes = [sum(len(p[2]) // 4 for p in w) for w in windows]
    assert max(sizes) <= 64 and sum(s < 64 for s in sizes) <= 1
    pieces = sorted((p for w in windows for p in w), key=lambda p: (p[0], p[1]))
    joined = {i: b"" for i in docs}
    for doc, start, ids, n in pieces:
        assert start == len(joined[doc]) // 4 and n == len(docs[doc]) // 4
        joined[doc] += ids
    assert joined == docs


def test_packer_minimises_squares():
    packer = packing.Packer(8)
    packer.counts[:] = [0, 0, 3, 0, 0, 1, 0, 0, 0]
    cost = lambda c: int((c[1:8] ** 2).sum())
    for size in range(1, 9):
        options = {}
        for level in range(0, 9 - size):
            if level == 0 or packer.counts[level]:
                after = packer.counts.copy()
                after[level] -= level > 0
                after[level + size] += 1
                options[level] = cost(after)
        assert options[packer.level_for(size)] == min(options.values())


def test_packed(spark, odd_docs, no_docs):
    df, texts = odd_docs
    library = Tokenizer.from_file(WORD)
    rows = packing.packed(df, WORD).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in texts:
        ids, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for sequence in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.packed(no_docs, WORD).count() == 0
