"""Removal of repeated byte strings against sets of all windows, and suffix arrays against plain sorting."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import repeats, suffixes

COLUMNS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def expected(rows, n=50):
    rows = [((1 << 63) - 1 if d is None else d, d, (t or "").encode()) for d, t in rows]
    first = {}
    for rank, _, text in rows:
        for i in range(len(text) - n + 1):
            w = text[i : i + n]
            first[w] = min(first.get(w, rank), rank)
    out = []
    for rank, doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - n + 1):
            if first[text[i : i + n]] < rank:
                gone[i : i + n] = b"\1" * n
        kept = bytes(c for c, g in zip(text, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df, **options):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = repeats.without_repeats(df, **options)
    return sorted((tuple(r) for r in found.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()), key=str)


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 3000}, {"chunk_bytes": 3000, "hot": 2}])
def test_random_documents(spark, options):
    rng = random.Random(8)
    words = ["alpha", "béta", "gamma", "delta", "x", "y", "🙂", "lorem", "ipsum"]
    shared = [" ".join(rng.choice(words) for _ in range(rng.choice([6, 12, 30]))) for _ in range(6)] + ["-" * 200, "ab" * 80]
    rows = []
    for i in range(120):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 5))]
        rows.append((rng.choice([i, i, i, i // 2, None]), "\n".join(parts)))
    rows += [(500, None), (501, ""), rows[3], (1, "z" * 49), (2, "z" * 50), (3, "z" * 51), (-7, "z" * 49 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = expected(rows)
    assert any(w[2] for w in want)
    assert digests(df, **options) == want


def test_exactly_fifty_bytes(spark):
    s = "".join(chr(33 + (i * 7) % 90) for i in range(50))
    rows = [(1, "abc" + s + "def"), (2, "uvw" + s + "xyz"), (3, "uvw" + s[1:] + "!"), (4, s)]
    got = {r[0]: r for r in digests(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert [got[i][2:4] for i in (1, 2, 3, 4)] == [(0, 0), (50, 1), (0, 0), (50, 1)]


def test_given_documents(spark, small):
    some = small.where("doc_id < 120")
    assert digests(some, chunk_bytes=60_000) == expected(pairs(some))


def test_odd_documents(documents, clashing, none):
    want = expected([(d, t) for d, t in pairs(documents)])
    assert digests(documents) == want and digests(clashing) == want
    assert digests(none) == []


def test_digest_columns(small):
    df = repeats.digests(small)
    assert df.columns == ["doc_id", *COLUMNS] and df.count() == small.count()


def test_texts_are_shuffled_once(small):
    plan = repeats.digests(small)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("ReusedExchange") >= 1 or "AdaptiveSparkPlan" in plan


@pytest.mark.parametrize("few", [0, 512])
def test_suffix_arrays(few, monkeypatch):
    monkeypatch.setattr(suffixes, "FEW", few)
    rng = random.Random(4)
    for _ in range(300):
        n, k = rng.randrange(1, 80), rng.choice([1, 2, 3, 20])
        text = np.array([rng.randrange(k) for _ in range(n)], np.int64)
        order = suffixes.suffix_array(text, k)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        shared = suffixes.common_prefixes((text + 1).astype(np.uint8), order)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            x, y = text[a:].tolist(), text[b:].tolist()
            assert shared[b] == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert shared[order[0]] == 0


def test_keys_of_equal_windows_are_equal():
    rng = random.Random(6)
    piece = bytes(rng.randrange(97, 123) for _ in range(300))
    texts = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(0, 200))) + piece for _ in range(5)]
    seen = {}
    text = np.frombuffer(b"".join(texts), np.uint8)
    for start, windows, key in zip(*repeats.segments(text, np.cumsum([len(t) for t in texts]))):
        for i in range(start, start + windows):
            assert seen.setdefault(text[i : i + 50].tobytes(), key) == key
    assert len(seen) == len({t[i : i + 50] for t in texts for i in range(len(t) - 49)})
