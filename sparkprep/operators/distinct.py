"""Equal whole rows found by fingerprints first.

Every row is reduced to two 64-bit hashes of its canonical cells, and only these and their counts are shuffled. A
fingerprint that occurs once belongs to a row without a copy. Rows with a repeated fingerprint are compared in full, so
the result is exact whatever the hashes. The list of repeated fingerprints is broadcast up to ``BROADCAST_PRINTS`` of
them (16 bytes each); with more, all rows are grouped by their full keys, with the same result.

The table is read twice or more, so it has to be deterministic, as everything that Spark may compute again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.missing import canonical, field_type, is_missing, qcol, text_key
from sparkprep.operators.profile import ATOMIC

BROADCAST_PRINTS = 1_000_000


def row_keys(df: DataFrame) -> list[Column]:
    """Canonical keys ``k0``, ``k1``, ... of all columns."""
    return [canonical(qcol(c), field_type(df, c)).alias(f"k{i}") for i, c in enumerate(df.columns)]


def row_print(df: DataFrame) -> list[Column]:
    """Two hashes of a row, ``p0`` and ``p1``, equal for equal rows (missing equals missing)."""
    cells = []
    for c in df.columns:
        dt = field_type(df, c)
        cells.append(canonical(qcol(c), dt) if isinstance(dt, ATOMIC) else text_key(qcol(c), dt))
    # Spark's hash passes over nulls, so where they are is hashed too
    gaps = [is_missing(df, c) for c in df.columns]
    return [F.xxhash64(F.lit(seed), *cells, *gaps).alias(f"p{seed}") for seed in (0, 1)]


def repeated_prints(df: DataFrame, most: int | None = None) -> DataFrame | None:
    """The fingerprints ``(p0, p1)`` of more than one row, for a broadcast; None if there are more than ``most``."""
    most = BROADCAST_PRINTS if most is None else most
    prints = df.select(*row_print(df)).groupBy("p0", "p1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("p0", "p1")
    found = prints.limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    return df.sparkSession.createDataFrame(found, "p0 bigint, p1 bigint")


def copies(df: DataFrame, most: int | None = None) -> DataFrame:
    """``n``: how many rows each group of equal rows has, for all groups of two and more (other groups may be there)."""
    keys = [f"k{i}" for i in range(len(df.columns))]
    repeated = repeated_prints(df, most)
    if repeated is None:
        suspects = df.select(*row_keys(df))
    else:
        suspects = df.select(*row_print(df), *row_keys(df)).join(F.broadcast(repeated), ["p0", "p1"], "left_semi")
    return suspects.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_rows(df: DataFrame, keep_copied: bool = True, most: int | None = None) -> DataFrame:
    """One row of each group of equal rows, as it came; without ``keep_copied`` rows without a copy only."""
    keys = [f"k{i}" for i in range(len(df.columns))]
    repeated = repeated_prints(df, most)
    row = F.struct(*[qcol(c) for c in df.columns]).alias("__row")
    if repeated is None:
        grouped, single = df.select(*row_keys(df), row), None
    else:
        printed = df.select(*row_print(df), *row_keys(df), row)
        grouped = printed.join(F.broadcast(repeated), ["p0", "p1"], "left_semi")
        single = printed.join(F.broadcast(repeated), ["p0", "p1"], "left_anti").select("__row.*")
    groups = grouped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.any_value("__row").alias("__row"))
    kept = (groups if keep_copied else groups.filter("n = 1")).select("__row.*")
    return kept if single is None else single.union(kept)
