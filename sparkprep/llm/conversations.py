"""Repair of the turn structure of conversations by the cheapest edits, with Four-Russians block tables.

A conversation is legal if its role initials read ``(s?(ua)+)?``. Rows can be kept, given the role that fits
(user or assistant), deleted, and empty rows can be inserted. The cost to finish from each of four positions in the
pattern is a vector; only finitely many vectors occur once their least entry is taken off. ``tables`` precomputes how
every block of ``BLOCK`` row symbols turns one such vector into another, so the backward pass over a conversation costs
one lookup a block and keeps one vector a block. The forward pass expands a block backward from the vector at its right
end and then takes, at each step, the least letter that still leads to a cheapest end. The pattern knows one role for
each position, so the letters alone decide the repaired rows, and ties fall to the least audit.

In Spark: one shuffle by conversation; the rows stream through sorted partitions, descending for the backward and
ascending for the forward pass. A conversation of any length takes the memory of one block (and of its own audit), but
its check sum is one running hash, so its rows pass through one task.

Defined cases: null roles and texts are one space, and so are null ids and turns inside the hash of the damage; rows
without conv_id form one conversation; rows of one turn are in order of role and text; repeated rows are duplicates; an
empty table gives no rows; a conversation that lost all its rows gives zeros, an empty audit and the hash of the empty
text; very long texts are carried whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Symbols in a block of the tables.
BLOCK = 4
#: Costs of the edits; a row that stays although it is truncated costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Positions in the pattern: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The position after the one role that can follow when it is not a system row.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Cost to finish a conversation that has no more rows.
AT_END = (0, 2 * INSERT, INSERT, 0)
INITIALS = "sua"
#: Row symbols: 0 must go; then for each initial (s, u, a, any other) sound and truncated.
SYMBOLS = 9


def kept(state: int, symbol: int) -> int | None:
    """The position after a row kept as it is, or None where its role does not fit."""
    initial = (symbol - 1) // 2
    if initial == 0:
        return SYSTEM if state == START else None
    return FOLLOWS[state] if initial < 3 and FOLLOWS[state] == initial + 1 else None


def choices(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """What can be done with a row: letter, cost and the position after it, by letter."""
    out = [("D", DELETE, state)]
    if symbol:
        extra = TRUNCATED if symbol % 2 == 0 else 0
        if (after := kept(state, symbol)) is not None:
            out.append(("K", extra, after))
        out.append(("R", REROLE + extra, FOLLOWS[state]))
    return out


def before(vector: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cost to finish from before a row, given the cost from after it."""
    costs = [min(c + vector[after] for _, c, after in choices(q, symbol)) for q in range(4)]
    for _ in range(3):  # an insertion may be followed by two more
        costs = [min(costs[q], INSERT + costs[FOLLOWS[q]]) for q in range(4)]
    return tuple(costs)


@lru_cache(1)
def tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """The vectors less their least entry (the first is that of the end), the vector before each symbol and before each block."""
    vectors, known, steps = [AT_END], {AT_END: 0}, []
    for vector in vectors:  # grows while it is read
        row = []
        for symbol in range(SYMBOLS):
            found = before(vector, symbol)
            found = tuple(c - min(found) for c in found)
            if found not in known:
                known[found] = len(vectors)
                vectors.append(found)
            row.append(known[found])
        steps.append(row)
    step = np.array(steps, np.int32)
    block = np.arange(len(vectors), dtype=np.int32)[:, None]
    for _ in range(BLOCK):  # the code of a block has its last row as the highest digit
        block = step[block].reshape(len(vectors), -1)
    return vectors, step, block


def expand(bound: int, symbols: list[int], state: int) -> tuple[list[str], int]:
    """The letters for the rows of a block, given the vector at its right end and the position at its left end.

    Letters of insertions stand before the row's own one.
    """
    vectors, _, _ = tables()
    after = [vectors[bound]]
    for symbol in reversed(symbols):
        after.append(before(after[-1], symbol))
    after.reverse()
    letters = []
    for i, symbol in enumerate(symbols):
        here, there, done = after[i], after[i + 1], ""
        while True:
            options = {letter: to for letter, cost, to in choices(state, symbol) if cost + there[to] == here[state]}
            if "D" not in options and INSERT + here[FOLLOWS[state]] == here[state]:
                done, state = done + "I", FOLLOWS[state]
                continue
            letter = min(options)
            state = options[letter]
            letters.append(done + letter)
            break
    return letters, state


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the contract's damage, with ``copy`` (1 for the repeated row) and ``lost``."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    hit = F.crc32(key) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (hit == 0).alias("lost"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def last_sign(text: Column) -> Column:
    """The last character that is no white space (empty if there is none)."""
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, lost, copy) dealt by conversation, with each row's first ``fault`` and ``symbol``."""
    order = [F.col("turn").asc_nulls_first(), F.col("copy")]
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "lost").orderBy(*order))
    end = last_sign(F.col("text"))
    fault = F.when(F.col("lost"), "lost").when(end == "", "blank").when(nth > 1, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("")
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin(*INITIALS), F.instr(F.lit(INITIALS), first)).otherwise(4)
    symbol = F.when(F.col("fault") == "lost", -1).when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(2 * initial - 1 + (F.col("fault") == "truncated").cast("int"))
    return rows.withColumn("fault", fault).withColumn("symbol", symbol.cast("int"))


def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending order: adds ``ahead`` (rows after it in its conversation) and ``bound`` (the vector at the end of its block)."""
    _, _, block = tables()
    now, ahead, bound, code, first = None, 0, 0, 0, True
    for batch in batches:
        counts, bounds = [], []
        for conv, symbol in zip(batch.column("conv_id").to_pylist(), batch.column("symbol").to_pylist()):
            if first or conv != now:
                now, ahead, bound, code, first = conv, 0, 0, 0, False
            counts.append(ahead)
            bounds.append(bound)
            if symbol >= 0:
                code = code * SYMBOLS + symbol
                ahead += 1
                if ahead % BLOCK == 0:
                    bound, code = int(block[bound, code]), 0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(bounds, pa.int32())], names=[*batch.schema.names, "ahead", "bound"])


REPAIRED = "turn {turn}, fault string, role string, edits string, new_role string, text string"


def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in ascending order: the letters of each row's edits; ``new_role`` is null for a row that goes.

    ``edits`` of a row has the insertions before it; insertions at the end are a row of their own with fault ``end``.
    """
    now, first, state, waiting = None, True, START, []

    def flush(out: list) -> None:
        nonlocal state, waiting
        if not waiting:
            return
        position = state
        letters, state = expand(waiting[0][-1], [w[5] for w in waiting], state)
        for (conv, turn, fault, role, text, _, _), edits in zip(waiting, letters):
            for letter in edits:
                position = after_letter(position, letter, role)
            out.append((conv, turn, fault, role, edits, None if edits[-1] == "D" else role if edits[-1] == "K" else ROLE[position], text))
        waiting = []

    def end(out: list) -> None:
        if not first and (missing := AT_END[state] // INSERT):
            out.append((now, None, "end", None, "I" * missing, None, None))

    names = ["conv_id", "turn", "fault", "role", "edits", "new_role", "text"]
    schema = None
    for batch in batches:
        if schema is None:
            schema = pa.schema([(n, batch.schema.field(n if n in batch.schema.names else "role").type) for n in names])
        out: list = []
        for conv, turn, role, text, fault, symbol, ahead, bound in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "symbol", "ahead", "bound")]):
            if first or conv != now:
                end(out)
                now, first, state, waiting = conv, False, START, []
            if symbol < 0:
                out.append((conv, turn, fault, role, "", None, None))
                continue
            waiting.append((conv, turn, fault, role, text, symbol, bound))
            if ahead % BLOCK == 0:
                flush(out)
        yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*out))] if out else [pa.array([], f.type) for f in schema], schema=schema)
    if schema is not None:
        out = []
        end(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*out))], schema=schema)


def after_letter(state: int, letter: str, role: str) -> int:
    if letter == "D":
        return state
    return SYSTEM if letter == "K" and role.startswith("s") else FOLLOWS[state]


def repair(rows: DataFrame) -> DataFrame:
    """Every row with its fault and edits, streamed by conversation in order of turn.

    ``rows`` has conv_id, turn, role, text (no nulls in the last two), ``lost`` (absent rows, kept only so that their
    conversation is not forgotten) and ``copy`` (order among equal rows). ``new_role`` and ``text`` are the repaired
    row; it is null for deleted rows. Rows come back partitioned by conversation and sorted.
    """
    schema = rows.schema
    conv, turn = schema["conv_id"].dataType.simpleString(), schema["turn"].dataType.simpleString()
    kept_columns = ["conv_id", "turn", "role", "text", "copy", "fault", "symbol"]
    marked = faults(rows.repartition("conv_id")).select(*kept_columns)
    tie = [F.col(c).desc() for c in ("role", "text", "copy")]
    down = marked.sortWithinPartitions(F.col("conv_id").desc(), F.col("turn").desc_nulls_last(), *tie, (F.col("fault") == "duplicate").desc())
    types = f"conv_id {conv}, turn {turn}, role string, text string, copy int, fault string, symbol int, ahead long, bound int"
    up = down.mapInArrow(backward, types).sortWithinPartitions("conv_id", F.col("ahead").desc())
    return up.mapInArrow(forward, f"conv_id {conv}, " + REPAIRED.format(turn=turn))


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a stream of repaired rows."""
    now: Summary | None = None
    conv = None
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in (d.split()[0] for d in DIGEST.split(", "))])
    kind = None
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for key, *row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "fault", "role", "edits", "new_role", "text")]):
            if now is None or key != conv:
                if now is not None:
                    out.append((conv, *now.result()))
                conv, now = key, Summary()
            now.add(*row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [kind, *schema.types])], names=["conv_id", *schema.names])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((conv, *now.result()), [kind, *schema.types])], names=["conv_id", *schema.names])


class Summary:
    """What the digest says of one conversation, from its rows in order."""

    def __init__(self) -> None:
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns, self.least, self.last = 0, None, None
        self.initial, self.illegal, self.cost, self.audit, self.state = None, 0, 0, [], START
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def add(self, turn, fault, role, edits, new_role, text) -> None:
        if fault == "lost":
            return
        if fault in self.faults:
            self.faults[fault] += 1
        for letter in edits:
            self.state = after_letter(self.state, letter, role or "")
            if letter == "I":
                self.line(ROLE[self.state], "")
        self.audit.append(edits)
        undeleted = new_role is not None
        self.cost += INSERT * edits.count("I") + DELETE * edits.count("D") + REROLE * edits.count("R") + TRUNCATED * (undeleted and fault == "truncated")
        if undeleted:
            self.line(new_role, text)
        if fault != "end":
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
            if turn is not None and turn != self.last:
                self.turns, self.last = self.turns + 1, turn
                self.least = turn if self.least is None else self.least

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def repaired(rows: DataFrame) -> DataFrame:
    """The query's digest of the damaged and repaired conversations."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    return repair(damage(rows)).mapInArrow(digest, f"conv_id {conv}, {DIGEST}")
