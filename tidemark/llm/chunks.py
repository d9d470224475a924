"""Encoding whole texts with one question per distinct chunk, in arrays.

A text is cut where no match of a tokenizer's pattern can lie across the cut, so its ids are the ids of its chunks one
after another. With `safe` for ASCII's visible characters and U+00C0-00FF, cuts lie

* before ASCII white space that follows a safe character, since no match goes from a character into white space after it;
* between one line break after a safe character and a safe character, since the line break is a match of its own then;
* between a letter (ASCII, or U+00C0-00FF) and an ASCII character that is neither letter nor white space, since runs of
  letters end there. All these letters are still letters after any normalizer used here; others, such as U+0130, which
  becomes a letter and a combining mark, stay in one chunk with what follows.

Chunks are compared by 128 bits made of all their bytes, and looked up in a table of fixed width per entry; ids of all
chunks lie in one array. New chunks of letters are asked for many at once. Texts that hold the string of an added token,
or a null character, are asked for whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa

from tidemark.llm.textarrays import mix

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Chunks that a memo holds before it shrinks to its first ones, which are the common ones, and that outlive a task.
MEMO, CORE, REST = 600_000, 300_000, 100_000
#: Ids of all chunks in a memo at most.
MEMO_IDS = 1 << 22
#: Bytes of text that are cut at once, and chunks that go to the library as one string.
AT_ONCE, TOGETHER = 1 << 18, 256

Words = Callable[[bytes, np.ndarray, bool], tuple[np.ndarray, np.ndarray]]


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_LETTER = _table((0x41, 0x5A), (0x61, 0x7A))
_VISIBLE = _table((0x21, 0x7E))
_SPACE = _table((0x09, 0x0D), (0x20, 0x20))
#: 64-bit masks of the first n bytes.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def cuts(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of some texts begin (firsts: where the texts do), and which bytes are of a letter."""
    letter, safe, space = _LETTER[data], _VISIBLE[data], _SPACE[data]
    plain = letter | (data == 0x20)
    if (data >= 0x80).any():
        lead = data == 0xC3  # of U+00C0-00FF
        last = np.r_[False, lead[:-1]]
        own = last & (data != 0x97) & (data != 0xB7)  # all letters but the signs of multiplication and division
        safe |= last
        letter |= own
        plain = letter | (lead & np.r_[own[1:], False])
    else:
        plain = letter
    at = np.zeros(len(data), bool)
    at[1:] = (space[1:] & safe[:-1]) | (letter[:-1] & _VISIBLE[data[1:]] & ~_LETTER[data[1:]])
    at[2:] |= (data[1:-1] == 0x0A) & safe[:-2] & (_VISIBLE[data[2:]] | (data[2:] == 0xC3))
    at[firsts[firsts < len(data)]] = True
    return np.flatnonzero(at), plain


def keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each chunk. data has 8 bytes after the last chunk."""
    words = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    a = words[starts] & _FIRST[np.minimum(sizes, 8)]
    b = np.zeros(len(starts), np.uint64)
    at, offset = np.flatnonzero(sizes > 8), 8
    b[at] = words[starts[at] + 8] & _FIRST[np.minimum(sizes[at] - 8, 8)]
    while len(at := at[sizes[at] > offset + 8]):
        offset += 8
        w = words[starts[at] + offset] & _FIRST[np.minimum(sizes[at] - offset, 8)]
        a[at] = mix(a[at] + w * _K[0])
        b[at] = mix((b[at] ^ w) * _K[1])
    n = sizes.astype(np.uint64)
    return mix(a * _K[0] + mix(b * _K[1] + n)), mix(b * _K[2] + mix(a * _K[3] ^ n))


class _Growing:
    """An array with room at its end."""

    def __init__(self, values: np.ndarray):
        self.room, self.n = values.copy(), len(values)

    def view(self) -> np.ndarray:
        return self.room[: self.n]

    def extend(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            self.room = np.concatenate([self.view(), np.zeros(max(1024, n, self.n // 2), self.room.dtype)])
        self.room[self.n : n] = values
        self.n = n


class Memo:
    """Ids of chunks by their 128 bits, in an open-addressed table that grows."""

    def __init__(self):
        self._new(*(np.zeros(0, np.uint64) for _ in range(2)), np.zeros(1, np.int64), np.zeros(0, np.uint32))

    def _new(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> None:
        self._all = [_Growing(x) for x in (a, b, ends, ids)]
        self._views()
        self._deal()

    def _views(self) -> None:
        self.a, self.b, self.ends, self.ids = (x.view() for x in self._all)
        self.n = len(self.a)

    def _deal(self) -> None:
        self.mask = (1 << max(14, (2 * self.n).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self._place(np.arange(self.n))

    def _place(self, entries: np.ndarray) -> None:
        slot = (self.a[entries] & np.uint64(self.mask)).astype(np.int64)
        while len(entries):
            free = self.slots[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.slots[slot[took]] = entries[took]
            left = np.ones(len(entries), bool)
            left[took] = False
            entries, slot = entries[left], (slot[left] + 1) & self.mask

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The entry of each chunk; -1: not known."""
        out = np.full(len(a), -1, np.int32)
        todo, slot = np.arange(len(a)), (a & np.uint64(self.mask)).astype(np.int64)
        while len(todo) and self.n:
            entry = self.slots[slot]
            same = (entry >= 0) & (self.a[entry] == a[todo]) & (self.b[entry] == b[todo])
            out[todo[same]] = entry[same]
            on = ~same & (entry >= 0)
            todo, slot = todo[on], (slot[on] + 1) & self.mask
        return out

    def add(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New chunks, with their numbers of ids, and their ids one after another."""
        before = self.n
        for own, values in zip(self._all, (a, b, self.ends[-1] + np.cumsum(sizes), ids), strict=True):
            own.extend(values)
        self._views()
        if self.n * 2 > self.mask:
            self._deal()
        else:
            self._place(np.arange(before, self.n))

    def shrink(self, n: int) -> None:
        if self.n > n:
            self._new(self.a[:n], self.b[:n], self.ends[: n + 1], self.ids[: self.ends[n]])


class Chunked:
    """Ids of whole texts put together from the ids of their chunks.

    ask: ids of each of some strings. words: from the bytes of many chunks of letters, one after another, their sizes,
    and whether each begins with a space (or none does) to their numbers of ids and the ids. added: strings of added
    tokens, which may hold or touch white space.
    """

    def __init__(self, ask: Callable[[list[str]], list[np.ndarray]], words: Words, added: list[str], most: int = MEMO, core: int = CORE):
        self.ask, self.words, self.added = ask, words, [a.encode() for a in [*added, "\0"]]
        self.memo, self.most, self.core = Memo(), most, core

    @contextmanager
    def task(self) -> Iterator[None]:
        """What a worker's memo holds beyond `REST` chunks goes when the task ends, so that nothing large outlives it."""
        try:
            yield
        finally:
            self.memo.shrink(REST)

    def batch(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after another, and their numbers."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, offsets, buffer = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer, np.uint8)[ends[0] : ends[-1]] if buffer is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        found, at = [], 0
        while at < len(texts):
            stop = max(at + 1, int(ends.searchsorted(ends[at] + AT_ONCE, "right")) - 1)
            found.append(self._some(data[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]))
            at = stop
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def _some(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        whole = np.zeros(0, np.int64)  # texts that are asked for as they are
        if any(a in raw for a in self.added):
            whole = np.flatnonzero([any(raw.find(a, s, e) >= 0 for a in self.added) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
        starts, plain = cuts(data, ends[:-1])
        sizes = np.diff(np.r_[starts, len(data)])
        entry = self._entries(raw, data, starts, sizes, plain)
        n = self.memo.ends[entry + 1] - self.memo.ends[entry]
        done = np.cumsum(n)
        ids = self.memo.ids[np.repeat(self.memo.ends[entry] - done + n, n) + np.arange(int(done[-1]) if len(done) else 0)]
        per = np.diff(np.r_[0, done][np.searchsorted(starts, ends)])
        if len(whole):
            parts = np.split(ids, np.cumsum(per)[:-1])
            for k, own in zip(whole, self.ask([raw[ends[k] : ends[k + 1]].decode() for k in whole]), strict=True):
                parts[k], per[k] = own, len(own)
            ids = np.concatenate(parts)
        if self.memo.n > self.most or len(self.memo.ids) > MEMO_IDS:
            few = int(self.memo.ends.searchsorted(MEMO_IDS // 2, "right")) - 1
            self.memo.shrink(min(self.core, few))
        return ids, per

    def _entries(self, raw: bytes, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """The memo's entries of the chunks, after what was not known has been learned."""
        a, b = keys(np.r_[data, np.zeros(8, np.uint8)], starts, sizes)
        entry = self.memo.find(a, b)
        missing = np.flatnonzero(entry < 0)
        if not len(missing):
            return entry
        _, first = np.unique(np.stack([a[missing], b[missing]], 1).view("V16").ravel(), return_index=True)
        new = missing[np.sort(first)]
        spaced = data[starts[new]] == 0x20
        letters = np.r_[0, np.cumsum(plain)]
        words = (letters[starts[new] + sizes[new]] - letters[starts[new]] == sizes[new] - spaced) & (sizes[new] > spaced)
        for kind in (True, False):
            own = new[words & (spaced == kind)]
            if len(own):
                begins = np.repeat(starts[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own])
                n, ids = self.words(data[begins + np.arange(len(begins))].tobytes(), sizes[own], kind)
                self.memo.add(a[own], b[own], n, ids)
        own = new[~words]
        if len(own):
            answers = self.ask([raw[s : s + k].decode() for s, k in zip(starts[own].tolist(), sizes[own].tolist(), strict=True)])
            self.memo.add(a[own], b[own], np.fromiter(map(len, answers), np.int64, len(answers)), np.concatenate(answers))
        entry[missing] = self.memo.find(a[missing], b[missing])
        return entry


def library_encoder(path: str) -> Chunked:
    """Ids of texts by the tokenizers library."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    spec = json.loads(library.to_str())

    def ask(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    # Tokens that end a word, or that begin with a space, tell where the ids of many chunks of letters are to be cut.
    vocabulary, ends = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix")
    mark = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    space, line = "Ġ", vocabulary.get("Ċ")  # a space and a line break in the byte-level alphabet
    for token, i in vocabulary.items():
        mark[i] = token.endswith(ends) if ends else token.startswith(space)
    marked = bool(ends) or (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"

    def words(data: bytes, sizes: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        stops = np.cumsum(sizes).tolist()
        starts = [0, *stops[:-1]]
        groups, at = [], list(range(0, len(stops), TOGETHER))
        for k in at:
            last = min(k + TOGETHER, len(stops))
            if spaced:
                groups.append(data[starts[k] : stops[last - 1]].decode())
            else:  # a line break before each chunk
                groups.append("".join("\n" + data[starts[i] : stops[i]].decode() for i in range(k, last)))
        counts, found = [], []
        answers = ask(groups) if marked else [np.zeros(0, np.uint32)] * len(groups)
        for k, ids in zip(at, answers, strict=True):
            size = min(TOGETHER, len(stops) - k)
            if ends:
                n = np.diff(np.r_[0, np.flatnonzero(mark[ids]) + 1])
            else:
                n = np.diff(np.r_[np.flatnonzero(mark[ids] if spaced else ids == line), len(ids)])
                if not spaced:
                    n, ids = n - 1, ids[ids != line]
            if len(n) != size or n.sum() != len(ids):
                each = ask([data[starts[i] : stops[i]].decode() for i in range(k, k + size)])
                n, ids = np.fromiter(map(len, each), np.int64, size), np.concatenate(each)
            counts.append(n)
            found.append(ids)
        return np.concatenate(counts), np.concatenate(found)

    return Chunked(ask, words, [t.content for t in library.get_added_tokens_decoder().values()])


@lru_cache(maxsize=4)
def encoder(path: str) -> Chunked:
    """One for each tokenizer file and Python worker, kept from task to task."""
    return library_encoder(path)


def vocabulary_path(name: str) -> str:
    return public_tokenizers.path(name)
