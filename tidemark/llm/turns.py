"""Repair of conversations by a min-plus scan over matrices, the cheapest edits first and among these the least audit.

A repaired conversation is empty, or an optional system turn followed by pairs of user and assistant. What stands so far is
one of four states: nothing, a system turn, a user turn, an assistant turn. Each row becomes a 4x4 matrix from state to
state, whose entries are (cost, audit): the ways to keep, re-role or delete the row after any number of inserted turns
(`CLOSURE`). Entries are added by the lesser (cost, then audit in ASCII order) and multiplied by adding costs and joining
audits. Two audits of equal cost over the same rows are never one the start of the other (the rest could only be inserted
turns, which cost), so order survives joining, the product is associative, and rows may be multiplied in any grouping.

Rows are range-partitioned in their order, so a long conversation spans tasks: every task multiplies what it has of a
conversation, and the few pieces at the edges of partitions are multiplied in a tree, `FAN` at a time. The repaired text is
then hashed in order; SHA-256 has no parallel form, so a conversation's text passes through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import join_counted, settled, table, tidy, written

#: Pieces of a conversation that one task multiplies in a round of the tree.
FAN = 16
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows whose product is looked up by their kinds, and products that a worker remembers.
SHORT, MEMO = 8, 20_000

Matrix = tuple[tuple[tuple[int, str] | None, ...], ...]
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: States from which a user turn, and from which an assistant turn may follow.
BEFORE_USER, BEFORE_ASSISTANT = (NONE, SYSTEM, ASSISTANT), (USER,)
#: A row's kind is 4 * initial of its role (s, u, a, other) + its fault.
INITIALS = "sua"
SOUND, CUT, GONE = range(3)


def matrix(entries: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(tuple(entries.get((i, j)) for j in range(4)) for i in range(4))


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: audits are joined only where their cost is the least."""

    def entry(i: int, j: int) -> tuple[int, str] | None:
        ways = [(x[0] + y[0], x[1], y[1]) for x, y in zip(a[i], (row[j] for row in b), strict=True) if x and y]
        if not ways:
            return None
        cost = min(w[0] for w in ways)
        return cost, min(x + y for c, x, y in ways if c == cost)

    return tuple(tuple(entry(i, j) for j in range(4)) for i in range(4))


UNIT = matrix({(i, i): (0, "") for i in range(4)})
_ONE = matrix({(i, i): (0, "") for i in range(4)} | {(i, USER): (INSERT, "I") for i in BEFORE_USER} | {(i, ASSISTANT): (INSERT, "I") for i in BEFORE_ASSISTANT})
#: Any number of inserted turns; more than two never are the cheapest way from a state to another.
CLOSURE = times(_ONE, _ONE)


@lru_cache(maxsize=None)  # twelve kinds
def of_row(kind: int) -> Matrix:
    """Insert closure and the edits of a row."""
    initial, fault = divmod(kind, 4)
    edits = {(i, i): (DELETE, "D") for i in range(4)}
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        steps = [(i, USER, "u") for i in BEFORE_USER] + [(i, ASSISTANT, "a") for i in BEFORE_ASSISTANT] + [(NONE, SYSTEM, "s")]
        for i, j, role in steps:
            if INITIALS[initial : initial + 1] == role:
                edits[i, j] = (more, "K")
            elif role != "s":
                edits[i, j] = (REROLE + more, "R")
    return times(CLOSURE, matrix(edits))


@lru_cache(maxsize=MEMO)
def _of_few(kinds: bytes) -> Matrix:
    return reduce(times, map(of_row, kinds), UNIT)


def of_rows(kinds: bytes) -> Matrix:
    """The product over rows, in a balanced tree: joining audits then costs n log n characters."""
    found = [_of_few(kinds[i : i + SHORT]) for i in range(0, len(kinds), SHORT)] or [UNIT]
    while len(found) > 1:
        found = [times(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0]


def cheapest(product: Matrix) -> tuple[int, str]:
    """Cost and audit of the whole: from nothing, through trailing inserts, to nothing or an assistant turn."""
    last = times(product, CLOSURE)[NONE]
    return min(x for x in (last[NONE], last[ASSISTANT]) if x)


#: A piece: consecutive rows of a conversation, with what is needed to join it to its neighbours.
PIECE = "part long, blank long, duplicate long, truncated long, illegal long, first_kind int, last_kind int, first_turn long, last_turn long, turns long, costs array<long>, audits array<string>"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _illegal(kinds: bytes) -> int:
    return sum((a // 4, b // 4) not in _LEGAL for a, b in zip(kinds, kinds[1:], strict=False))


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring pieces as one."""
    same_turn = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + ((a["last_kind"] // 4, b["first_kind"] // 4) not in _LEGAL)
    out |= {"part": a["part"], "first_kind": a["first_kind"], "last_kind": b["last_kind"], "turns": a["turns"] + b["turns"] - same_turn}
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    out["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    return out | {"product": times(a["product"], b["product"])}


def _flat(product: Matrix) -> dict:
    cells = [x or (None, None) for row in product for x in row]
    return {"costs": [c for c, _ in cells], "audits": [a for _, a in cells]}


def _matrix(costs: list, audits: list) -> Matrix:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return tuple(tuple(cells[i : i + 4]) for i in range(0, 16, 4))


def _schema(ddl: str, df: DataFrame) -> tuple[str, pa.Schema]:
    """A schema as DDL, with conv_id as in `df`, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {ddl}"
    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    Rows are taken by turn (null first), then role, then the text's SHA-256. A null role or text is one space. Repeated
    rows count as often as they occur, and all but the first are duplicates. Rows with a null conv_id are one conversation.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = rows.sparkSession
    blank_as = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank_as(role).alias("role"), blank_as(text).alias("text"))
    return settled(spark, lambda: _repaired(spark, plain.withColumn("n", F.lit(1))), "repaired")


def _repaired(spark: SparkSession, plain: DataFrame) -> DataFrame:
    """plain: conv_id, turn, role, text (neither null), n (how often the row counts)."""
    # Equal rows are counted before anything else, so no later step has more than one row of a group of copies.
    rows = plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    end = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(end == "", GONE).when(F.substring(end, -1, 1).isin(".", "!", "?"), SOUND).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    digest = F.unhex(F.sha2("text", 256))
    same = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", F.hex(digest)), 256))
    rows = written(spark, rows.select("*", (number * 4 + fault).alias("kind"), digest.alias("digest"), same.alias("same")), "turns")

    turn = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    seen = written(spark, rows.groupBy("same").agg(F.min(turn).alias("seen"), F.count(F.lit(1)).alias("_n")), "seen")
    thin = join_counted(rows.select("conv_id", "turn", "role", "digest", "kind", "n", "same"), seen, "same", rows.count())
    first = F.col("turn").eqNullSafe(F.col("seen.b")) & (F.col("kind") % 4 != GONE)
    thin = thin.select("conv_id", "turn", "role", "digest", "kind", "n", first.alias("first"))

    order = ["conv_id", "turn", "role", "digest"]
    ddl, arrow = _schema(f"edge boolean, {PIECE}", rows)
    pieces = thin.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "kind", "n", "first")
    pieces = written(spark, pieces.mapInArrow(_pieces(arrow), ddl), "pieces")
    whole = pieces.filter("not edge").drop("edge")
    edges, most = pieces.filter("edge").drop("edge"), pieces.agg(F.max("part")).first()[0] or 0
    ddl, arrow = _schema(PIECE, rows)
    while True:  # once at least: one partition may hold both ends of a conversation, or a file's rows come in parts
        edges = written(spark, edges.groupBy("conv_id", F.expr(f"part div {FAN}").alias("_up")).applyInArrow(_joined(arrow), ddl), "edges")
        most //= FAN
        if not most:
            break

    ddl, arrow = _schema("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string", rows)
    return whole.unionByName(edges).mapInArrow(_judged(arrow), ddl).transform(lambda found: _hashed(rows, found))


def _hashed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`found` with repaired_sha256: each conversation's answer comes before its rows in one sorted stream."""
    answers = found.select("conv_id", F.struct(*found.columns[1:]).alias("answer"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "digest", "n")])
    turns = rows.select("conv_id", F.lit(None).cast(answers.schema["answer"].dataType).alias("answer"), "turn", "role", "text", "digest", "n")
    stream = answers.unionByName(turns).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("answer").isNull(), "turn", "role", "digest")
    ddl, arrow = _schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema[1:]) + ", repaired_sha256 string", found)
    return stream.select("conv_id", "answer", "role", "text", "n").mapInArrow(_hashes(arrow), ddl)


def _pieces(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, now = TaskContext.get().partitionId(), None, None

        def done(edge: bool) -> pa.RecordBatch:
            conv, kinds, counts, turns = now
            kinds = bytes(kinds)
            piece = {"conv_id": conv, "edge": edge, "part": part, **counts, "illegal": _illegal(kinds), "first_kind": kinds[0], "last_kind": kinds[-1]}
            piece |= {"first_turn": turns[0], "last_turn": turns[1], "turns": turns[2]} | _flat(of_rows(kinds))
            return piece

        ready, size, first_conv = [], 0, True
        for batch in batches:
            for conv, turn, kind, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        ready.append(done(first_conv))
                        size, first_conv = size + len(now[1]), False
                    now = (conv, bytearray(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), [None, None, 0])
                _, kinds, counts, turns = now
                fault = kind % 4
                if fault == GONE:
                    counts["blank"] += n
                    kinds += bytes([kind]) * n
                else:
                    again = n - first
                    counts["duplicate"] += again
                    counts["truncated"] += first and fault == CUT
                    kinds += bytes([kind]) * first + bytes([kind - fault + GONE]) * again
                if turn is not None and turn != turns[1]:
                    turns[0] = turn if turns[0] is None else turns[0]
                    turns[1], turns[2] = turn, turns[2] + 1
            if size > 20_000:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready, size = [], 0
        if now is not None:
            ready.append(done(True))
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema)

    return tidy(run)


def _joined(schema: pa.Schema):
    def run(pieces: pa.Table) -> pa.Table:
        found = sorted(pieces.to_pylist(), key=lambda p: p["part"])
        for p in found:
            p["product"] = _matrix(p.pop("costs"), p.pop("audits"))
        while len(found) > 1:
            found = [joined(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
        out = found[0]
        out |= _flat(out.pop("product")) | {"conv_id": pieces.column("conv_id")[0].as_py(), "part": out["part"] // FAN}
        return pa.Table.from_pylist([out], schema)

    return run


def _judged(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                gaps = 0 if p["first_turn"] is None else p["last_turn"] - p["first_turn"] + 1 - p["turns"]
                cost, audit = cheapest(_matrix(p["costs"], p["audits"]))
                out.append({"gaps": gaps, "cost": cost, "audit": audit} | {k: p[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal")})
            yield pa.RecordBatch.from_pylist(out, schema)

    return tidy(run)


class _Repair:
    """The repaired rows of a conversation, hashed one after another as the audit says."""

    def __init__(self, audit: str):
        self.audit, self.at, self.out, self.sha = audit, 0, 0, hashlib.sha256()
        self.total = len(audit) - audit.count("D")

    def _add(self, role: str | None, text: str) -> None:
        """role: None for the one that must stand here; the last turn is the assistant's, and roles alternate."""
        if role is None:
            role = "user" if (self.total - self.out) % 2 == 0 else "assistant"
        self.sha.update((("\n" if self.out else "") + role + ":" + text).encode())
        self.out += 1

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._add(None, "")
            self.at += 1

    def row(self, role: str, text: str, n: int) -> None:
        for _ in range(n):
            self.inserted()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit != "D":
                self._add(role if edit == "K" else None, text)

    def digest(self) -> str:
        self.inserted()
        return self.sha.hexdigest()


def _hashes(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready = None, []
        for batch in batches:
            columns = [batch.column(name) for name in ("conv_id", "answer", "role", "text", "n")]
            for conv, answer, role, text, n in zip(*columns, strict=True):
                if answer.is_valid:
                    if now:
                        ready.append(now[0] | {"repaired_sha256": now[1].digest()})
                    answer = answer.as_py()
                    now = (answer | {"conv_id": conv.as_py()}, _Repair(answer["audit"]))
                else:
                    now[1].row(role.as_py(), text.as_py(), n.as_py())
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready = []
        if now:
            yield pa.RecordBatch.from_pylist([now[0] | {"repaired_sha256": now[1].digest()}], schema)

    return tidy(run)


def damaged(rows: DataFrame) -> DataFrame:
    """`conversations` with faults put in by the checksum of conv_id and turn; n says how often a row counts."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    kept = rows.filter(fault != 0)
    return kept.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("n"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged and repaired; one without rows after the damage has zeros."""
    rows = table(spark, sf_dir, "conversations")

    def built() -> DataFrame:
        found = _repaired(spark, damaged(rows)).withColumnRenamed("conv_id", "_conv")
        every = rows.groupBy("conv_id").agg(F.lit(0).alias("_"))
        out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

    return settled(spark, built, "repaired")
