"""Repair of conversations against a plain search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkprep.llm import conversations

SF = "/root/testdata/sf0.001"
TYPES = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def fault(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def legal_so_far(initials):
    return re.fullmatch("s?(ua)*u?", initials) is not None


def cheapest(rows, faults):
    """Dijkstra over (cost, audit): the first finished one popped is the cheapest with the least audit."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        # what can follow depends on the last initial and on whether anything stands before it
        state = (at, initials[-1:], bool(initials))
        if at == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, lines
        if state in done:
            continue
        done.add(state)
        moves = [("I", 2, at, r, f"{r}:") for r in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at][2:]
            moves.append(("D", 3, at + 1, None, None))
            if faults[at] in ("", "truncated"):
                extra = faults[at] == "truncated"
                moves.append(("K", extra, at + 1, role or "-", f"{role}:{text}"))
                moves += [("R", 2 + extra, at + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for letter, price, to, role, line in moves:
            now = initials + role[0] if role else initials
            if role is None or legal_so_far(now):
                heapq.heappush(heap, (cost + price, audit + letter, to, now, lines if line is None else (*lines, line)))


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        now = damaged([r for r in rows if r[0] == conv])
        faults = fault(now)
        turns = [r[1] for r in now if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(now, now[1:]))
        cost, audit, lines = cheapest(now, faults)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = conversations.repaired(df).select("conv_id", *names).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def test_random_conversations(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", " \t", "Why?", "a\nb", "end. \r\n", None, "x" * 5000 + "!"]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "User"]
    rows = []
    for conv in [*range(400), None]:
        n = rng.choice([1, 1, 2, 3, 4, 5, 8, 9, 17])
        for i in range(n):
            turn = rng.choice([i, i, i, i, i + 7, None, 3])
            role = rng.choice(roles) if rng.random() < 0.5 else ["user", "assistant"][i % 2]
            rows.append((conv, turn, role, rng.choice(texts) if rng.random() < 0.5 else f"Words {i}."))
    rows += rows[:40]
    df = spark.createDataFrame(rows, TYPES).repartition(5)
    assert found(df) == expected(rows)


def test_given_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(df) == expected([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_a_long_conversation_and_other_columns(spark):
    n = 2_000
    df = spark.range(n).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Line "), "id", F.lit(".")).alias("text"),
        F.lit(1).alias("symbol"), F.lit("x").alias("fault"), F.lit(2).alias("copy"), F.lit(3).alias("bound"),
    )
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Line {i}.") for i in range(n)]
    assert found(df) == expected(rows)


def test_no_rows(spark):
    assert found(spark.createDataFrame([], TYPES)) == {}


def test_all_rows_lost(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark.createDataFrame([(conv, 0, "user", "Hi.")], TYPES)) == {conv: (0, 0, 0, 0, 0, 0, "", empty)}


def test_repaired_rows_are_legal(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = conversations.repair(conversations.damage(df)).where("edits rlike '[KR]'").select("conv_id", "new_role", "text").collect()
    assert rows and all(r.new_role in ("user", "assistant", "system") and r.text is not None for r in rows)


@pytest.mark.parametrize("vector", range(16))
def test_block_tables_are_single_steps(vector):
    vectors, step, block = conversations.tables()
    for code in range(0, conversations.SYMBOLS**conversations.BLOCK, 37):
        now, rest = vector, []
        for _ in range(conversations.BLOCK):
            code, rest = code // conversations.SYMBOLS, [code % conversations.SYMBOLS, *rest]
        for symbol in rest:
            now = step[now, symbol]
        whole = 0
        for symbol in rest:
            whole = whole * conversations.SYMBOLS + symbol
        assert block[vector, whole] == now
