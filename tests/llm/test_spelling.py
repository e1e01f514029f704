"""Spelling variants against a plain search over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import spelling

COLUMNS = ["form", "root", "n", "n_near", "form_n"]


def vocabulary(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(rows):
    words = vocabulary(rows)
    close = {w: [o for o in words if one_apart(w, o)] for w in words}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), words[w], len(close[w]), words[form[w]] if form[w] else None) for w in words}


def found(df, **options):
    rows = spelling.variants(df, **options).select("word", *COLUMNS).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_given_documents(spark, small):
    some = small.orderBy("doc_id").limit(60)
    assert found(some) == expected(pairs(some))


@pytest.mark.parametrize("most", [spelling.NODE, 3])
def test_random_words(spark, most):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abé") for _ in range(rng.choice([7, 8, 9]))) for _ in range(25)] + ["x" * 60, "Überall", "a×bcdefg÷"]
    def bent(w):
        w = list(w)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [w[at], "b"], ["a"], ["Z"]])
        return "".join(w)
    rows = [(rng.choice([i, i, None]), " ".join(bent(rng.choice(stems)) for _ in range(30))) for i in range(60)]
    rows += [(1000, " ".join(["commonword"] * 5000 + ["commonwort"] * 400 + ["comonwort"] * 30 + ["comonwrt"] * 2)), (1001, None), (1002, ""), (1003, "short words only"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = expected(rows)
    assert any(v[0] for v in want.values()) and any(v[0] != v[1] and v[0] for v in want.values())
    assert found(df, most=most) == want


def test_odd_documents(spark, documents, clashing):
    want = expected(pairs(documents))
    assert found(documents) == want and found(clashing) == want


def test_no_rows(none):
    assert found(none) == {}


def test_one_edit():
    rng = random.Random(1)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 70))) for _ in range(300)] + [b"ab" * 30, b"ab" * 30 + b"a", b"ab" * 29 + b"bb"]
    a, b = (x.ravel() for x in np.meshgrid(range(len(words)), range(len(words))))
    other = np.array([words[i] != words[j] for i, j in zip(a, b)])
    a, b = a[other], b[other]
    assert spelling.Words(words).near(a, b).tolist() == [one_apart(words[i], words[j]) for i, j in zip(a, b)]


def test_words_that_share_a_path_count(spark):
    """A vocabulary of anagrams lies in one leaf however deep the trie is."""
    rng = random.Random(2)
    letters = list("abcdefgh")
    words = set()
    while len(words) < 400:
        rng.shuffle(letters)
        words.add("".join(letters))
    table = spark.createDataFrame([(w, 2) for w in words] + [("abcdefghi", 5)], "word string, n long").withColumn("n", F.col("n"))
    rows = {(r.word, r.other) for r in spelling.near_pairs(table, most=50).collect()}
    every = [*words, "abcdefghi"]
    assert rows == {(a, b) for a in every for b in every if one_apart(a, b)}
