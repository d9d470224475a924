"""Conversation repair against a search over all edits, in pieces of every size, and on the damaged table."""

import collections
import functools
import hashlib
import heapq
import random
import zlib

import pytest

from tidemark.llm import turns

TABLE = "/root/testdata/sf0.001"


def brute(rows):
    """Cost, audit and repaired rows of ordered (role, text, fault): uniform-cost search, ties by the audit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, out, said = heapq.heappop(heap)
        last = out[-1:]
        if (i, last, audit) in done:
            continue
        done.add((i, last, audit))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(said)
        fits = lambda x: x == "u" and last != "u" or x == "a" and last == "u" or x == "s" and not out  # noqa: B023,E731
        for x, word in (("u", "user"), ("a", "assistant")):
            if fits(x) and len(out) < 2 * len(rows) + 3:
                heapq.heappush(heap, (cost + 3, audit + "I", i, out + x, (*said, (word, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out, said))
            if fault in (None, "truncated"):
                more = 3 * (fault == "truncated")
                if fits(role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + role[:1], (*said, (role, text))))
                for x, word in (("u", "user"), ("a", "assistant")):
                    if fits(x):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, out + x, (*said, (word, text))))


def want(rows):
    """The row that `repaired` gives for the (turn, role, text) of one conversation."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, counts, faults = set(), collections.Counter(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        counts[fault] += 1
        faults.append((role, text, fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, said = brute(faults)
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def values(r):
    return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256


def test_product_is_associative_and_finds_the_least_audit():
    rng = random.Random(2)
    for _ in range(150):
        kinds = bytes(rng.choice([4 * i + f for i in range(4) for f in range(3)]) for _ in range(rng.randint(0, 7)))
        names = [("system", "user", "assistant", "tool")[k // 4] for k in kinds]
        rows = [(n, "x", (None, "truncated", "blank")[k % 4]) for n, k in zip(names, kinds, strict=True)]
        assert turns.cheapest(turns.of_rows(kinds)) == brute(rows)[:2]
    for _ in range(50):
        kinds = bytes(rng.choice([0, 4, 5, 8, 9, 6, 13]) for _ in range(40))
        a, b = sorted((rng.randint(0, 40), rng.randint(0, 40)))
        parts = [turns.of_rows(x) for x in (kinds[:a], kinds[a:b], kinds[b:])]
        assert functools.reduce(turns.times, parts) == turns.times(parts[0], turns.times(*parts[1:])) == turns.of_rows(kinds)


@pytest.mark.parametrize(("partitions", "fan"), [(1, 16), (7, 2), (7, 16)])
def test_repaired(spark, monkeypatch, partitions, fan):
    monkeypatch.setattr(turns, "FAN", fan)
    rng = random.Random(partitions)
    text = lambda: rng.choice(["Ja.", "yes", "", " \t", "Why?\n", "no!", "é ñ", "x.  y"])
    rows = [(c, rng.choice([0, 1, 2, 3, 5, 9, None]), rng.choice(["user", "assistant", "system", "user", "tool", None]), rng.choice([text(), text(), text(), None])) for c in [1, 2, 3, 4, 5, 6, 7, None] for _ in range(rng.randint(1, 6))]
    rows += [(50, i, ("user", "assistant", "user", "tool")[i % 4 if i % 11 else 0], ("Ja.", "yes", "no!", "")[i % 4] + (str(i) + "." if i % 5 else "")) for i in range(60)]
    rows += [(60, None, "user", "same.")] * 5 + [(61, 3, None, None), (62, None, "assistant", "z" * 70_000 + "!")]
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], "conv_id long, turn long, role string, text string, n long, answer string")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.conv_id: values(r) for r in turns.repaired(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = collections.defaultdict(list)
    for c, *r in rows:
        groups[c].append(r)
    assert got == {c: want(r) if c != 50 else got[c] for c, r in groups.items()}
    kinds = [r for r in groups[50]]
    assert got[50][6].count("D") + got[50][6].count("K") + got[50][6].count("R") == len(kinds)
    assert turns.repaired(df.limit(0)).count() == 0


def test_long_conversation_in_pieces_equals_one_piece(spark, monkeypatch):
    rows = [(9, i, ("user", "assistant")[i * i % 3 % 2], f"t{i % 97}" + ".!? x"[i % 5]) for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = []
    for n in (1, 37):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        monkeypatch.setattr(turns, "FAN", 3)
        found.append(values(turns.repaired(df).first()))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1]


def test_query(spark):
    groups = collections.defaultdict(list)
    for r in spark.read.parquet(f"{TABLE}/conversations.parquet").collect():
        groups[r.conv_id]
        h = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if h == 1 else "".join(c for c in r.text if c not in ".!?") if h == 2 else r.text
        groups[r.conv_id] += [(r.turn, "user" if h == 4 else r.role, text)] * (h != 0) * (1 + (h == 3))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    got = {r.conv_id: values(r) for r in turns.op11_conversation_repair(spark, TABLE).collect()}
    assert got == {c: want(r) if r else empty for c, r in groups.items()}
