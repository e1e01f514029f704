"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells. A row's key falls in a cell, a shard's virtual nodes stand in cells, and a row's home
is the first node clockwise from its cell. Each shard has a capacity; rows that find their home full continue clockwise
to the next shard with room. Homes are served before rows that move on, so only the overflow moves. Rows of a cell are
told apart by their rank in it, so the whole assignment follows from the counts of the cells: a table of fixed size.

With ``load`` 1 (the query's value) the capacities are the two whole numbers around rows / shards and add up to the
rows, so counts are at most one apart: the law ``rows``. A larger ``load`` leaves shards room and moves fewer rows.

Defined cases: a null text counts no bytes and has the CRC of the empty text; a null key is a key like any other; equal
rows are ranked among themselves in any order and are interchangeable; a very long text counts by its size only; columns
beside doc_id and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, cut, text_of

SHARDS = 24
NODES = 32
CELLS = 4096
LAW = "rows"


def cell_of(*cols) -> F.Column:
    """The cell of a key: the leading bits of its 64-bit hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - int(math.log2(CELLS))).cast("int")


def ring(spark: SparkSession, shards: int, nodes: int) -> list[int]:
    """The shards met clockwise, as the owner of each virtual node with its cell: (cell, shard), in ring order."""
    node = spark.range(shards * nodes).select((F.col("id") / nodes).cast("int").alias("shard"), cell_of(F.lit("node"), "id").alias("cell"))
    return sorted((r.cell, r.shard) for r in node.collect())  # shards * nodes rows


def capacities(rows: int, shards: int, load: float) -> list[int]:
    if load <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil(load * rows / shards)] * shards


def allot(counts: dict[tuple[int, int], int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Serve the ring: (cell, salt, first rank, rank after the last, shard, first slot) for every run of rows.

    In each round every cell with rows left offers them to its next node clockwise. ``counts`` has an entry for each
    cell and salt, whose number is bounded, so this is work of a fixed size whatever the data.
    """
    used, room = [0] * len(room), list(room)
    starts = {}
    for cell, _ in counts:
        starts.setdefault(cell, next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0))
    waiting = [(cell, salt, 0, n, starts[cell]) for (cell, salt), n in sorted(counts.items())]
    out = []
    while waiting:
        later = []
        for cell, salt, done, n, at in waiting:
            shard = nodes[at][1]
            take = min(n - done, room[shard])
            if take:
                out.append((cell, salt, done, done + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if done + take < n:
                later.append((cell, salt, done + take, n, (at + 1) % len(nodes)))
        waiting = later
    return out


def shard(rows: DataFrame, keys: list[str], shards: int = SHARDS, nodes: int = NODES, load: float = 1.0) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard). ``rows`` should be narrow: it is written once.

    A cell's rows are ranked in ``SALTS`` parts, by a hash of all their columns, so that a hot key is split unless its
    rows are equal in every column, and no row's place depends on where it was read.
    """
    spark = rows.sparkSession
    names = rows.columns
    kept = cut(
        rows.withColumn("__cell", cell_of(F.lit("key"), *[F.coalesce(F.col(k).cast("string"), F.lit("\\N")) for k in keys]))
        .withColumn("__salt", F.pmod(F.xxhash64(F.lit("salt"), *names), F.lit(SALTS)).cast("int"))
    )
    counts = {(r["__cell"], r["__salt"]): r["count"] for r in kept.groupBy("__cell", "__salt").count().collect()}  # at most CELLS * SALTS
    runs = allot(counts, ring(spark, shards, nodes), capacities(sum(counts.values()), shards, load))
    table = spark.createDataFrame(runs, "c int, s int, lo long, hi long, shard int, at long")
    place = Window.partitionBy("__cell", "__salt").orderBy(*keys, *[n for n in names if n not in keys])
    ranked = kept.withColumn("__rank", F.row_number().over(place) - 1)
    # a run for each cell and salt and a few more at the cuts: bounded as counts is
    at = (F.col("__cell") == F.col("c")) & (F.col("__salt") == F.col("s")) & F.col("__rank").between(F.col("lo"), F.col("hi") - 1)
    return ranked.join(F.broadcast(table), at).select(*names, "shard", (F.col("at") + F.col("__rank") - F.col("lo")).alias("slot"))


def shards(docs: DataFrame) -> DataFrame:
    """The query's digest: sizes and check sums of the texts, and the place of every document."""
    size = (F.octet_length(text_of("text")) + 8).cast("long")
    narrow = docs.select("doc_id", size.alias("size"), F.crc32(text_of("text").cast("binary")).alias("text_crc32"))
    return shard(narrow, ["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
