"""Spelling variants of the words of a corpus, found in a trie of letter-group counts.

A word's letters fall into ``GROUPS`` groups, and the counts by group, one level after the other, are its path in a trie.
One inserted, deleted or replaced letter raises at most one count by one (surplus) and lowers at most one by one
(deficit), so a depth-first search that spends a budget of one each reaches every near word; words in the leaves reached
are verified letter by letter. The search carries all words that ask down the trie together, each with what is left of
its budget.

In Spark: counts of words are combined inside Arrow batches, then by word. The upper ``depth`` levels of the trie are a
shuffle key: every word lies in the node of its own counts and asks in the nodes within the budget that come after its
own, so each pair meets once. ``depth`` grows until no node holds more than ``NODE`` words; at the full depth a node has
words with the same counts in every group only. A word's form has ten times its count at least, so chains of forms are
short, and roots are found by doubling.

Defined cases: null texts have no words, a null doc_id is the empty text inside the hash; letters are those of the
contract (code points up to U+00FF), which makes a word's Latin-1 bytes its code points; equal rows count each; ties of
the largest count go to the smaller word; very long texts and words are read whole; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut

RUN = re.compile("[a-zÀ-ÿ]{7,}")
LETTERS, TWICE = 7, 2
#: One run in so many loses a letter (the contract's damage).
DAMAGED = 31
#: A form occurs so many times as often as its variant.
TIMES = 10
#: The levels of the trie. Letters not named (accents) are dealt to them by code point.
LEVELS = ("e", "a", "i", "n", "r", "t", "o", "s", "l", "u", "d", "c", "m", "h", "gp", "bf", "kv", "wy", "xz", "jq")
#: Most words in a node of the upper trie, while it can be made deeper.
NODE = 50_000
#: The upper levels to begin with.
DEPTH = 1
#: Rows of a shard of the search (words that lie and words that ask).
SHARD = 150_000
#: Words that ask at a time, and pairs compared at a time.
ASKING = 1 << 14
PAIRS = 1 << 17
#: Words up to this long are compared in one matrix, longer ones one by one.
WIDTH = 48


def level_of_letter() -> np.ndarray:
    found = np.arange(256) % len(LEVELS)
    for level, letters in enumerate(LEVELS):
        for letter in letters:
            found[ord(letter)] = level
    return found


OF_LETTER = level_of_letter()


def words_of(doc_id, text: str | None) -> Counter:
    """The words of a text after the damage, with how often they occur."""
    out: Counter = Counter()
    if not text:
        return out
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes: only A-Z are lower-cased
        h = zlib.crc32(run.encode(), start)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LETTERS:
            out[run] += n
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of every word that occurs often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found.update(words_of(doc_id.as_py(), text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


def counts(words: list[bytes]) -> np.ndarray:
    """The path of each word: one row of counts, big-endian, so that bytes order like counts."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = OF_LETTER[np.frombuffer(b"".join(words), np.uint8)]
    flat = np.repeat(np.arange(len(words)), lengths) * len(LEVELS) + letters
    found = np.bincount(flat, minlength=len(words) * len(LEVELS)).reshape(len(words), len(LEVELS))
    return np.minimum(found, 0xFFFF).astype(">u2")  # a cut count never raises a difference


def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = counts([w.encode("latin-1") for w in batch.column(0).to_pylist()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in rows], pa.binary())], names=[*batch.schema.names, "path"])


def moves(depth: int) -> np.ndarray:
    """All differences of the upper levels within the budget that lead to a later node, and none at all."""
    found = [np.zeros(depth, np.int64)]
    for up in range(-1, depth):
        for down in range(-1, depth):
            if up != down:
                step = np.zeros(depth, np.int64)
                if up >= 0:
                    step[up] += 1
                if down >= 0:
                    step[down] -= 1
                if step[np.flatnonzero(step)[0]] > 0:
                    found.append(step)
    return np.array(found)


def spread(depth: int):
    """Each word to its own node (``asks`` false) and to the later nodes that it reaches (true)."""
    steps = moves(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = np.frombuffer(b"".join(batch.column("path").to_pylist()), ">u2").reshape(batch.num_rows, -1)[:, :depth].astype(np.int64)
            for i, step in enumerate(steps):
                to = path + step
                rows = np.flatnonzero((to >= 0).all(1) & (to <= 0xFFFF).all(1))
                nodes = [r.tobytes() for r in to[rows].astype(">u2")]
                chosen = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), chosen.column("word"), chosen.column("n"), pa.array(np.full(len(rows), i > 0))], names=["node", "word", "n", "asks"]
                )

    return run


class Words:
    """Words as rows of letters, aligned at their starts and at their ends, to compare many pairs at once."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.wide = int(self.size[self.size <= WIDTH].max(initial=1))
        letters = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(len(words)), self.size)
        column = np.arange(len(letters)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.left, self.right = np.zeros((2, len(words), self.wide), np.uint8)
        fits = self.size[row] <= self.wide
        row, column, letters = row[fits], column[fits], letters[fits]
        self.left[row, column] = letters
        self.right[row, self.size[row] - column - 1] = letters  # from the last letter on

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of different words are one edit apart."""
        out = np.abs(self.size[a] - self.size[b]) <= 1
        out &= (self.left[a, 0] == self.left[b, 0]) | (self.right[a, 0] == self.right[b, 0])  # one end stays
        rows = np.flatnonzero(out)
        short = np.maximum(self.size[a[rows]], self.size[b[rows]]) <= self.wide
        for i in rows[~short]:
            out[i] = one_edit(self.words[a[i]], self.words[b[i]])
        rows = rows[short]
        x, y = a[rows], b[rows]
        same = (common(m[x], m[y]) for m in (self.left, self.right))
        out[rows] = sum(same) >= np.maximum(self.size[x], self.size[y]) - 1
        return out


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many letters two rows have in common before the first that differs."""
    return (x != y).argmax(1)


def one_edit(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Children:
    """The child of a node for a count: looked up in a table, or by binary search where a table would be mostly empty."""

    def __init__(self, node: np.ndarray, count: np.ndarray):
        self.base, self.keys, self.table = int(count.max(initial=0)) + 1, None, None
        keys = node.astype(np.int64) * self.base + count
        cells = (int(node.max(initial=0)) + 1) * self.base
        if cells <= 64 * len(keys):
            self.table = np.full(cells, -1, np.int32)
            self.table[keys] = np.arange(len(keys))
        else:
            self.keys = keys

    def of(self, node: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The children, -1 where there is none."""
        good = (count >= 0) & (count < self.base)
        wanted = np.where(good, node.astype(np.int64) * self.base + count, 0)
        if self.table is not None:
            return np.where(good, self.table[wanted], -1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(good & (self.keys[at] == wanted), at, -1)


class Trie:
    """Paths (rows of counts) from level ``depth`` on. ``roots`` names the node that each path has at that level."""

    def __init__(self, path: np.ndarray, roots: np.ndarray, depth: int):
        self.order = np.lexsort((*path[:, : depth - path.shape[1] - 1 : -1].T, roots)) if depth < path.shape[1] else np.argsort(roots, kind="stable")
        path, roots = path[self.order], roots[self.order]
        new = np.r_[True, roots[1:] != roots[:-1]]
        self.first = roots[new]  # the trie's roots, in order
        node = np.cumsum(new) - 1
        self.children = []
        for level in range(depth, path.shape[1]):
            new[1:] |= path[1:, level] != path[:-1, level]
            self.children.append(Children(node[new], path[new, level]))
            node = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        self.starts, self.sizes = starts, np.diff(np.r_[starts, len(path)])

    def reach(self, path: np.ndarray, who: np.ndarray, root: np.ndarray, surplus: np.ndarray, deficit: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word that asks (a row of ``path``) and a word in a leaf within its budget, as positions."""
        at = np.minimum(np.searchsorted(self.first, root), len(self.first) - 1)
        here = self.first[at] == root
        who, node, surplus, deficit = who[here], at[here], surplus[here], deficit[here]
        for level, children in enumerate(self.children, level):
            count, parts = path[who, level], []
            for gap, may in ((0, None), (1, surplus > 0), (-1, deficit > 0)):
                rows = np.arange(len(who)) if may is None else np.flatnonzero(may)
                child = children.of(node[rows], count[rows] - gap)
                rows, child = rows[child >= 0], child[child >= 0]
                parts.append((who[rows], child, surplus[rows] - (gap > 0), deficit[rows] - (gap < 0)))
            who, node, surplus, deficit = (np.concatenate(p) for p in zip(*parts))
        sizes = self.sizes[node]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(who, sizes), self.order[np.repeat(self.starts[node], sizes) + within]


def search(words: list[bytes], nodes: list[bytes], asks: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs, each once, between the words that lie in a node and those that ask there, as positions in ``words``."""
    path = counts(words).astype(np.int32)
    lie = np.flatnonzero(~asks)
    if not len(lie):
        return
    number = {n: i for i, n in enumerate(dict.fromkeys(nodes))}
    root = np.fromiter((number[n] for n in nodes), np.int64, len(nodes))
    trie = Trie(path[lie], root[lie], depth)
    letters = Words(words)
    there = np.frombuffer(b"".join(number), ">u2").reshape(len(number), depth).astype(np.int64)
    for at in range(0, len(words), ASKING):
        who = np.arange(at, min(at + ASKING, len(words)))
        gap = path[who, :depth] - there[root[who]]
        a, b = trie.reach(path, who, root[who], 1 - np.maximum(gap, 0).sum(1), 1 - np.maximum(-gap, 0).sum(1), depth)
        b = lie[b]
        once = asks[a] | (a < b)
        a, b = a[once], b[once]
        for some in range(0, len(a), PAIRS):
            x, y = a[some : some + PAIRS], b[some : some + PAIRS]
            good = letters.near(x, y)
            yield x[good], y[good]


def pairs_of(depth: int):
    """All near pairs of a shard's nodes, in both directions."""

    def run(table: pa.Table) -> pa.Table:
        names, n = table.column("word"), table.column("n").to_numpy()
        words = [w.encode("latin-1") for w in names.to_pylist()]
        found = list(search(words, table.column("node").to_pylist(), table.column("asks").to_numpy(), depth))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1))
        one, two = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.table({"word": names.take(pa.array(one)), "other": names.take(pa.array(two)), "other_n": pa.array(n[two], pa.int64())})

    return run


def depth_for(vocabulary: DataFrame, most: int = NODE) -> int:
    """The least number of upper levels at which no node holds more than ``most`` words (or all levels)."""
    for depth in range(DEPTH, len(LEVELS)):
        largest = vocabulary.groupBy(F.substring("path", 1, 2 * depth)).count().agg(F.max("count")).first()[0]
        if (largest or 0) <= most:
            return depth
    return len(LEVELS)


def near_pairs(vocabulary: DataFrame, most: int = NODE) -> DataFrame:
    """``word``, ``other``, ``other_n`` for every ordered pair of words (``word``, ``n``) that are one edit apart."""
    pathed = cut(vocabulary.mapInArrow(paths, "word string, n long, path binary"))
    depth = depth_for(pathed, most)
    shards = pathed.count() * len(moves(depth)) // SHARD + 1
    asked = pathed.mapInArrow(spread(depth), "node binary, word string, n long, asks boolean")
    dealt = asked.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(pairs_of(depth), "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: the end of the chain of forms, for every word that has a form."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    longest = forms.agg(F.max("form_n")).first()[0] or 0
    steps = 1  # links of a chain that one lookup follows
    while TWICE * TIMES ** (steps + 1) <= longest:
        there = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = cut(attach(now, there, ["root"], chars="beyond").select("word", F.coalesce("beyond", "root").alias("root")))
        steps *= 2
    return now


def variants(docs: DataFrame, most: int = NODE) -> DataFrame:
    """For every word its count, the number of near words, its form and root."""
    vocabulary = cut(count_words(docs))
    found = near_pairs(vocabulary, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    told = vocabulary.join(found, "word", "left")
    good = -F.col("best.n") >= TIMES * F.col("n")
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n")))
    ends = roots(told.where(F.col("form").isNotNull()))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
