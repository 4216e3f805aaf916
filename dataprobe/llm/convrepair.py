"""Conversation structure repair: cheapest edits that make turns alternate, by Four-Russians block tables.

A repaired conversation is empty or an optional system turn followed by user and assistant turns in pairs. A turn is
kept (0), given the role user or assistant (2) or deleted (3; blank and repeated turns must be); an empty user or
assistant turn is inserted anywhere for 2; a truncated turn that is not deleted adds 1.

What is left to pay after each row is a vector over four states (nothing yet, after a system, a user, an assistant
turn). Less its smallest entry such a vector takes only a few values, so the step over every block of ``BLOCK`` rows
is looked up in a table made once: (vector after the block, its symbols) gives the vector before it and the cost to
add. Blocks are looked up from the last to the first; then each block is expanded backward into the vectors between
its rows and traced forward, taking at every step the ASCII-least edit that still is cheapest, which gives the least
audit of all cheapest ones. Traces are looked up too, by (vector, block, state).

Rows travel without their texts until the edits are known: equal rows are counted before any shuffle, repeated
texts are found by grouping, the rows are range-partitioned in conversation order, so a long conversation spreads over
tasks, and each split becomes one byte per row. Only those bytes meet in one task, which also makes the audit, a
cell of as many letters. The texts are shuffled once, to be read in order beside their edits: in a stream, since the
hash of a repaired conversation can only be computed from its first byte to its last.

Null ids, roles and texts: rows with a null id are one conversation; a null role or text counts as one space. Turns
are ordered by number, nulls first, those with the same number by role and a hash of role and text, so that repeated
rows stand together. Any other columns are left out. A table without rows gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
BLOCK = 4

# roles by initial: 0 system, 1 user, 2 assistant, 3 any other; faults: 0 none, 1 truncated, 2 duplicate, 3 blank
TRUNCATED, DUPLICATE, BLANK = 1, 2, 3
#: the state after an inserted or rewritten turn: user, or assistant after a user
_NEXT = (2, 2, 3, 2)
#: the state after a kept turn, by role; -1 where it may not stand
_KEEP = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
#: what is left to pay after the last row
_END = (0, 2 * INSERT, INSERT, 0)
#: symbols of the tables: role * 2 + truncated, one for all rows that must go, one that pads the first block
_MUST_GO, _PAD = 8, 9


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """What is left to pay before a row, from what is left after it."""
    if symbol == _PAD:
        return after
    cost = [DELETE + a for a in after]
    if symbol != _MUST_GO:
        role, cut = symbol >> 1, CUT * (symbol & 1)
        for q in range(4):
            cost[q] = min(cost[q], REROLE + cut + after[_NEXT[q]])
            if _KEEP[role][q] >= 0:
                cost[q] = min(cost[q], cut + after[_KEEP[role][q]])
    user, assistant = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return min(cost[0], INSERT + user), min(cost[1], INSERT + user), user, assistant


class Tables:
    """Normalised vectors, the steps of one symbol and of whole blocks, and the traces met so far."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = [_END]
        place = {_END: 0}
        step, add = [], []
        for v in self.vectors:  # grows while new vectors are met
            ids, costs = [], []
            for symbol in range(10):
                w = _before(v, symbol)
                low = min(w)
                w = tuple(x - low for x in w)
                if w not in place:
                    place[w] = len(self.vectors)
                    self.vectors.append(w)
                ids.append(place[w])
                costs.append(low)
            step.append(ids)
            add.append(costs)
        self.step, self.add = np.array(step), np.array(add)
        block, cost, width = self.step, self.add, 10
        while width < 10**BLOCK:
            n = len(self.vectors)
            # the later half of the block steps first; symbols count from the earlier half
            cost = (cost[block] + cost[:, :, None]).transpose(0, 2, 1).reshape(n, width * width)
            block = block[block].transpose(0, 2, 1).reshape(n, width * width)
            width *= width
        self.block, self.cost = block.tolist(), cost.tolist()
        self._traces: dict[tuple[int, int, int], tuple[str, int]] = {}

    def trace(self, after: int, block: int, state: int) -> tuple[str, int]:
        """The letters of one block entered in ``state``, and the state after it."""
        key = (after, block, state)
        if key not in self._traces:
            symbols = [block // 10 ** (BLOCK - 1 - i) % 10 for i in range(BLOCK)]
            inner = [after]
            for s in reversed(symbols):
                inner.append(int(self.step[inner[-1], s]))
            letters = []
            for i, s in enumerate(symbols):
                later = inner[BLOCK - 1 - i]
                state = self._row(s, self.vectors[later], int(self.add[later, s]), self.vectors[inner[BLOCK - i]], state, letters)
            self._traces[key] = "".join(letters), state
        return self._traces[key]

    @staticmethod
    def _row(symbol: int, after: tuple[int, ...], add: int, before: tuple[int, ...], q: int, letters: list[str]) -> int:
        if symbol == _PAD:
            return q
        cut = CUT * (symbol & 1) if symbol != _MUST_GO else 0
        while True:
            left = before[q] + add
            if DELETE + after[q] == left:
                letters.append("D")
                return q
            if INSERT + before[_NEXT[q]] + add == left:
                letters.append("I")
                q = _NEXT[q]
                continue
            kept = _KEEP[symbol >> 1][q]
            if kept >= 0 and cut + after[kept] == left:
                letters.append("K")
                return kept
            letters.append("R")
            return _NEXT[q]

    def solve(self, symbols: np.ndarray) -> tuple[int, str]:
        """Cost and least audit of the cheapest edits for rows given as role * 4 + fault."""
        fault = symbols & 3
        code = np.where(fault >= DUPLICATE, _MUST_GO, (symbols >> 2) * 2 + fault)
        code = np.concatenate([np.full(-len(code) % BLOCK, _PAD), code]).reshape(-1, BLOCK)
        blocks = (code @ (10 ** np.arange(BLOCK - 1, -1, -1))).tolist()
        after, total, now = [], 0, 0
        for b in reversed(blocks):
            after.append(now)
            total += self.cost[now][b]
            now = self.block[now][b]
        total += self.vectors[now][0]
        letters, state = [], 0
        for b, v in zip(blocks, reversed(after)):
            part, state = self.trace(v, b, state)
            letters.append(part)
        return total, "".join(letters) + "I" * (_END[state] // INSERT)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _turns(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns under fixed names, nulls filled, and how often each row stands (1)."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), F.lit(1).alias("copies"))


def damage(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows damaged by a checksum of id and turn modulo 20, where 0 drops the row
    (copies 0), 1 empties its text, 2 removes its end marks, 3 repeats it (copies 2) and 4 makes its role user."""
    rows = _turns(df, conv_id, turn, role, text)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "utf-8")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", "role")})


def _symbols(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, h1, h2, copies, symbol``: equal rows once, their symbol role * 4 + fault of the first."""
    space = " \t\n\x0b\f\r"
    last = F.expr("right(_t, 1)")
    seen = _hashed(rows).withColumn("_t", F.rtrim(F.col("text"), F.lit(space)))
    fault = F.when(F.col("_t") == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    each = seen.select("conv_id", "turn", "role", "h1", "h2", "copies", fault.alias("fault")).groupBy("conv_id", "turn", "role", "h1", "h2").agg(F.sum("copies").alias("copies"), F.first("fault").alias("fault"))
    # where the same role and text stands under several turns, the first of them
    first = each.filter("copies > 0").groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("turn")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    first = first.select(F.col("conv_id").alias("_c"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "_first")
    both = each.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    later = F.col("_first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn")) & (F.col("fault") != BLANK)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = kind * 4 + F.when(later, DUPLICATE).otherwise(F.col("fault"))
    return both.select("conv_id", "turn", "role", "h1", "h2", F.col("copies").cast("long").alias("copies"), symbol.cast("int").alias("symbol"))


def _segments(rows: DataFrame) -> DataFrame:
    """``conv_id, split, symbols, lo, hi, turns``: the rows of a conversation in each range split, one byte a row."""
    ordered = rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), *_order()).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order())
    ordered = ordered.select("conv_id", F.spark_partition_id().alias("split"), "turn", "copies", "symbol")
    kind = rows.schema["conv_id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # conv_id, split, symbols, lo, hi, turns of the conversation being read
        for b in batches:
            done = []
            typ = b.schema.field("conv_id").type
            for conv, split, turn, copies, symbol in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if not now or now[0] != conv:
                    if now:
                        done.append(now)
                    now = [conv, split, bytearray(), None, None, 0]
                if copies:
                    now[2].append(symbol)
                    now[2].extend(bytes([symbol if symbol & 3 == BLANK else symbol & ~3 | DUPLICATE]) * (copies - 1))
                    if turn is not None and turn != now[4]:
                        now[3] = turn if now[3] is None else now[3]
                        now[4], now[5] = turn, now[5] + 1
            yield _batch(done, typ)
        if now:
            yield _batch([now], typ)

    def _batch(done: list, typ: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*done)) if done else [[]] * 6
        types = [typ, pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([bytes(x) if t == pa.binary() else x for x in c], t) for c, t in zip(cols, types)], ["conv_id", "split", "symbols", "lo", "hi", "turns"])

    return ordered.mapInArrow(scan, f"conv_id {kind.simpleString()}, split int, symbols binary, lo long, hi long, turns long")


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _judge(segments: list[dict]) -> tuple[list[int], str]:
    """The six counts and the audit of one conversation from its segments in order."""
    symbols = np.frombuffer(b"".join(s["symbols"] for s in segments), np.uint8).astype(np.int64)
    known = [s for s in segments if s["turns"]]
    turns = sum(s["turns"] for s in known) - sum(a["hi"] == b["lo"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["hi"] - known[0]["lo"] + 1 - turns if known else 0
    fault, role = np.bincount(symbols & 3, minlength=4), symbols >> 2
    pairs = role[:-1] * 4 + role[1:]
    legal = np.isin(pairs, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
    cost, audit = tables().solve(symbols)
    return [gaps, int(fault[BLANK]), int(fault[DUPLICATE]), int(fault[TRUNCATED]), int((~legal).sum()), cost], audit


def edits(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (as ``damage`` returns them): conv_id, gaps (missing numbers between its
    turns), blank, duplicate, truncated (rows by first fault), illegal (neighbours out of turn), cost, audit."""
    segments = _segments(_symbols(rows))
    gathered = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("split", "symbols", "lo", "hi", "turns"))).alias("segments"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_judge(s) for s in b.column(1).to_pylist()]
            counts = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([f[1] for f in found], pa.string())], ["conv_id", *_COUNTS, "audit"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return gathered.mapInArrow(scan, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string")


def _beside(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan followed by its rows in order, conversation by conversation."""
    heads = plans.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), *_COUNTS)
    nothing = [F.lit(None).cast("long").alias(c) for c in _COUNTS]
    turns = _hashed(rows).filter("copies > 0").select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "copies", "h1", "h2", *nothing)
    both = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", *_order())
    return both.drop("h1", "h2", "turn")


class _Reader:
    """Takes the letters of one audit as its rows come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._turn(), ""

    def _turn(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == 2 else "assistant"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _KEEP["sua".index(role[0])][self.state]
            yield "K", role, text
        elif letter == "R":
            yield "R", self._turn(), text


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, object]]:
    """("head", (batch, row)), then ("turn", (edit, role, text)) for every turn of the repaired conversation, then ("end", None)."""
    reader = None
    for b in batches:
        part, role, text, copies = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("part", "role", "text", "copies"))
        for i in range(b.num_rows):
            if part[i] == 0:
                if reader is not None:
                    yield from (("turn", t) for t in reader.inserted())
                    yield "end", None
                reader = _Reader(text[i])
                yield "head", (b, i)
            else:
                for _ in range(copies[i]):
                    yield from (("turn", t) for t in reader.row(role[i], text[i]))
    if reader is not None:
        yield from (("turn", t) for t in reader.inserted())
        yield "end", None


def repaired(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the turns of every repaired conversation, places from 0, and whether each
    was kept (K), given its role (R) or inserted (I)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, typ, conv, place = [], None, None, 0
        for what, value in _walk(batches):
            if what == "head":
                typ, conv, place = value[0].schema.field("conv_id").type, value[0].column(0)[value[1]].as_py(), 0
            elif what == "turn":
                out.append((conv, place, *value))
                place += 1
            if len(out) >= 1000:
                yield _rows(out, typ)
                out = []
        if out:
            yield _rows(out, typ)

    def _rows(out: list, typ: pa.DataType) -> pa.RecordBatch:
        types = [typ, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "place", "edit", "role", "text"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _beside(rows, edits(rows)).mapInArrow(scan, f"conv_id {kind}, place long, edit string, role string, text string")


def digest(rows: DataFrame) -> DataFrame:
    """One row per conversation: the columns of ``edits`` and the SHA-256 of its repaired ``role:text`` lines."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, sums, sha, lines = [], [], None, 0
        for what, value in _walk(batches):
            if what == "head":
                b, i = value
                # a copy of the row, so that the batch with its texts can go
                heads.append({n: b.column(b.schema.get_field_index(n))[i].as_py() for n in ["conv_id", *_COUNTS, "text"]})
                typ, sha, lines = b.schema.field("conv_id").type, hashlib.sha256(), 0
            elif what == "turn":
                sha.update((b"\n" if lines else b"") + f"{value[1]}:{value[2]}".encode("utf-8", "surrogatepass"))
                lines += 1
            else:
                sums.append(sha.hexdigest())
                if len(sums) >= 1000:
                    yield _rows(heads, sums, typ)
                    heads, sums = [], []
        if sums:
            yield _rows(heads, sums, typ)

    def _rows(heads: list[dict], sums: list[str], typ: pa.DataType) -> pa.RecordBatch:
        cols = [pa.array([h["conv_id"] for h in heads], typ), *[pa.array([h[c] for h in heads], pa.int64()) for c in _COUNTS]]
        return pa.RecordBatch.from_arrays([*cols, pa.array([h["text"] for h in heads], pa.string()), pa.array(sums)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return _beside(rows, edits(rows)).mapInArrow(scan, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")
