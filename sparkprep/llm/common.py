"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.session import ensure_checkpoint_dir

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A table joined to rows of the corpus is broadcast only when it was counted and fits these bounds.
BROADCAST_ROWS = 50_000
BROADCAST_CHARS = 4_000_000
SALTS = 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, so that a lost executor loses no finished work."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_of(name: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the values of ``cols`` only (52 bits of an MD5)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def attach(df: DataFrame, table: DataFrame, on: Sequence[str], chars: str | None = None) -> DataFrame:
    """Left-join a lookup ``table`` (unique, null-safe on ``on``) to every row of ``df``.

    The table is counted first. Within ``BROADCAST_ROWS`` rows (and, with ``chars`` naming its only wide column,
    ``BROADCAST_CHARS`` characters of it) it is broadcast; beyond that both sides are shuffled with ``df`` salted and
    the table repeated for each salt, so that a hot key is read by ``SALTS`` tasks.
    """
    size = F.coalesce(F.sum(F.length(chars)), F.lit(0)) if chars else F.lit(0)
    rows, wide = table.agg(F.count(F.lit(1)), size).first()
    renamed = table.select(*[F.col(c).alias(f"__on_{c}") if c in on else F.col(c) for c in table.columns])
    match = [df[c].eqNullSafe(renamed[f"__on_{c}"]) for c in on]
    if rows <= BROADCAST_ROWS and wide <= BROADCAST_CHARS:
        out = df.join(F.broadcast(renamed), match, "left")
    else:
        salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        repeated = renamed.withColumn("__on_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        match = [salted[c].eqNullSafe(repeated[f"__on_{c}"]) for c in on]
        out = salted.join(repeated, [*match, salted["__salt"] == repeated["__on_salt"]], "left").drop("__salt", "__on_salt")
    return out.drop(*[f"__on_{c}" for c in on])
