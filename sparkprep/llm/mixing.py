"""Mixing sources to target weights.

Tokens are summed by source, a repetition rate follows from each source's target, and a document is emitted
``floor(rate)`` times plus once more if its hash-seeded coin, whose probability is the fraction, falls so.

Defined cases: a null or empty text has size 0 and is emitted like any other document of its source; a null source is a
source of its own, ordered last; a null doc_id takes part in the coin as a value of its own; equal rows share a coin; an
empty table gives no rows; other columns, whatever their names, are carried by :func:`mix` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import attach, count_words, cut, text_of, uniform

#: The contract of the query: weights by rank, share of all sizes, and the most a source is repeated.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20


def rank_sources(sizes: DataFrame) -> DataFrame:
    """Number sources (``__source``) by code point from 0, null last, without gathering them in one task.

    Range partitions are written once; a row's rank is its place in its partition plus the rows of those before.
    """
    spark = sizes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("__source").asc_nulls_last()
    dealt = cut(
        sizes.repartitionByRange(parts, order)
        .sortWithinPartitions(order)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__id", 33).cast("int"))
        .withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__id")
    )
    # one row for each partition: bounded by the number of partitions
    before = dealt.groupBy("__part").count().select("__part", (F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    return (
        dealt.join(F.broadcast(before), "__part")
        .withColumn("__rank", F.col("__place") + F.coalesce("__before", F.lit(0)))
        .drop("__part", "__place", "__before")
    )


def targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, source: str = "source", size: str = "__size") -> DataFrame:
    """One row for each source: ``__source``, ``__source_size`` and ``__target``.

    Sources share ``share`` times all sizes by weight. A target that would exceed ``most`` times its source's size
    stops there, and the excess is shared again by weight among the others until none is above. Every round is one
    aggregate over the table of sources; no source reaches the driver, only the sums do.
    """
    sums = docs.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("__source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = cut(rank_sources(sums).withColumn("__weight", F.element_at(cycle, (F.pmod("__rank", F.lit(len(weights))) + 1).cast("int"))))
    goal = share * float(table.agg(F.sum("__source_size")).first()[0] or 0)
    limit = F.lit(most) * F.col("__source_size")
    level, full = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("__weight") * F.lit(level) >= limit
        now, held, free = table.agg(
            F.sum(F.when(capped, 1).otherwise(0)), F.sum(F.when(capped, limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("__weight")))
        ).first()
        if not free or now == full:  # nothing is left to share, or no further source stopped
            break
        full, level = now, (goal - held) / free
    level = 0.0 if level is None else level
    return table.select("__source", "__source_size", F.least(F.col("__weight") * F.lit(level), limit).alias("__target"))


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, keys: tuple[str, ...] = ("doc_id",), text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target`` and ``__copies`` (how often a document is emitted)."""
    sized = docs.withColumn("__size", count_words(text_of(text)))
    found = attach(sized.withColumn("__source", F.col(source)), targets(sized, weights, share, most, source), ["__source"], "__source")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    coin = uniform(seed, *[F.col(k) for k in keys]) < rate - F.floor(rate)
    return found.withColumn("__copies", F.floor(rate) + F.when(coin, 1).otherwise(0)).drop("__source")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document repeated as its source's rate says."""
    repeated = copies(docs, **options).where("__copies > 0")
    return repeated.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def taken(docs: DataFrame, **options) -> DataFrame:
    """The digest of the mix by document: doc_id, size, source_size, target and the words taken."""
    return copies(docs.select("doc_id", "text", "source"), **options).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").cast(T.LongType()).alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).cast(T.LongType()).alias("taken"),
    )


#: The same rule in SQL. With limits sorted by size per weight, the level is the one at which the sources below are full.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS lim FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(lim) OVER (ORDER BY lim / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) /
    sum(weight) OVER (ORDER BY lim / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM l WHERE weight * level < lim), lim) AS target FROM l
), r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('20|' || coalesce(doc_id::VARCHAR, '\N')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
