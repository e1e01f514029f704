"""SimHash near-duplicates by a segment-popcount embedding.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Distinct fingerprints are
embedded by the number of set bits in each two-bit segment. The Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints, so a range join of the embeddings within the allowed distance finds every pair.
Counts are written in unary (0, 1, 2 as 00, 01, 11), which makes the Manhattan distance the number of differing bits.

The grid: segments are dealt to groups, a cell is the counts of all but ``distance`` groups. Points within ``distance``
differ in at most so many groups, so they share a cell of at least one choice of groups, and a pair is taken only from
the first choice that it shares. What the range join leaves is verified on the fingerprints, and the links are joined to
components by star contraction, each round written to the shared folder.

Defined cases: a text without a word (also null) has fingerprint zero and is linked like any other; a text with fewer
words than a shingle is one shingle; documents with equal fingerprints are one node, so copies make no pairs; documents
with a null doc_id are linked too, and a component without any doc_id gets null; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Groups of segments. More groups make cells smaller (fewer pairs to verify) and each fingerprint be in more of them.
GROUPS = 6
#: Shingles hashed at a time, so that a very long text takes bounded memory.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, BLOCK):
        part = words[at : min(at + BLOCK, last) + shingle - 1]
        rows = map(b" ".join, zip(*[part[k:] for k in range(shingle)])) if len(words) >= shingle else [b" ".join(part)]
        hashes = np.array([xxhash.xxh64_intdigest(r, SEED) for r in rows], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, fp long")


def unary_counts(fp: Column) -> Column:
    """The embedding: of each two-bit segment the number of set bits, in unary."""
    odd = F.lit(0x5555555555555555)
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(odd), fp.bitwiseAND(odd)
    return high.bitwiseOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def group_masks(groups: int) -> list[int]:
    """The bits of each group: segments 0 to 31 dealt to the groups in runs."""
    masks = [0] * groups
    for segment in range(32):
        masks[segment * groups // 32] |= 3 << (2 * segment)
    return masks


def links(prints: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """Pairs (``a`` < ``b``) of distinct fingerprints ``fp`` that differ in at most ``distance`` bits, each once."""
    masks = group_masks(groups)
    choices = list(combinations(range(groups), groups - distance))
    cells = F.explode(
        F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), F.col("code").bitwiseAND(F.lit(signed(sum(masks[g] for g in c)))).alias("cell")) for i, c in enumerate(choices)])
    )
    points = prints.select("fp").withColumn("code", unary_counts(F.col("fp"))).select("fp", "code", cells.alias("at")).select("fp", "code", "at.choice", "at.cell")
    a, b = points.alias("a"), points.alias("b")
    away = F.col("a.code").bitwiseXOR(F.col("b.code"))
    # the first choice all of whose groups agree, from the groups that do
    first = F.coalesce(*[F.when(away.bitwiseAND(F.lit(signed(sum(masks[g] for g in c)))) == 0, F.lit(i)) for i, c in enumerate(choices)])
    near = (
        (F.col("a.choice") == F.col("b.choice"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(away) <= distance)
        & (first == F.col("a.choice"))
    )
    pairs = a.join(b, near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) for every node of ``edges`` (a, b).

    Alternates the large-star and small-star steps: each node hands its neighbours to the smallest of them. Edges become
    stars around the roots. Every round's edges are written, so neither lineage nor lost executors repeat the rounds.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        seen = both.join(least, "a")
        hand = seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else seen.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return hand.where("a <> b").distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    while True:
        now = cut(star(star(now, True), False))
        if (after := state(now)) == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """For every document ``key``, ``fp`` and ``component`` (the smallest key of its component)."""
    prints = cut(fingerprints(docs, key, text, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(links(nodes, distance, groups))
    # the few fingerprints with a link take the smallest key of their component, the others their own
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("of_all"))
    smallest = linked.join(least, "root").select(F.col("fp").alias("linked"), "of_all")
    named = nodes.join(smallest, nodes["fp"] == smallest["linked"], "left").select(
        "fp", F.when(F.col("linked").isNotNull(), F.col("of_all")).otherwise(F.col("least")).alias("component")
    )
    # many copies share a fingerprint: Spark splits the large side of the skewed join, as both sides are plain shuffles
    named = cut(named)
    return prints.join(named, "fp").select("key", "fp", "component")


def groups_of(docs: DataFrame) -> DataFrame:
    """The query's digest: doc_id, the fingerprint in hex and the component."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, the one with the smallest key, with the columns of ``docs``.

    Rows with the same key and text are one document.
    """
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("__row"), F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h")).alias("__id"), F.col(text).alias("__text"))
    found = near_duplicates(rows, "__id", "__text", **options)
    firsts = found.where(F.col("key") == F.col("component")).select(F.col("key").alias("__id")).distinct()
    packed = rows.select("__id", "__row")
    if (rows.groupBy("__id").count().agg(F.max("count")).first()[0] or 0) > 1:  # whole rows are only sorted where some are equal
        packed = packed.dropDuplicates(["__id"])
    return packed.join(firsts, "__id", "left_semi").select("__row.*")
