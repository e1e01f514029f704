"""Profiling: long value counts (V1), exact quantiles, mode, dataset profile,
overview, column-type table, describe, before/after comparison, correlation.

Scale notes
-----------
* Every per-column statistic that needs distinct values comes from **one**
  shuffle: the table is unpivoted to ``(column, value)`` and grouped, with a
  map-side partial count, so a value holding a third of all rows collapses
  to one row per map task before the exchange.
* Quantiles are exact without an unbounded buffer or a ranking window, by
  repeated selection at every size (:mod:`sparkprep.operators.quantiles`).
* Per-column top-k / mode use ``row_number() <= k`` windows, which Spark
  plans as a map-side ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.functions.missing import (
    canonical,
    field_type,
    is_float,
    is_missing,
    is_numeric,
    is_text,
    missing_safe,
    qcol,
    text_key,
)
from sparkprep.operators.quantiles import HOLD, CountedValues, RawRows, as_table, select

ATOMIC = (
    T.NumericType,
    T.StringType,
    T.BooleanType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.CharType,
    T.VarcharType,
)


def atomic_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, ATOMIC)]


def _spark(df: DataFrame):
    return df.sparkSession


# --------------------------------------------------------------------- V1
def value_counts_long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Non-missing value counts of many columns in one shuffle.

    Returns ``(column string, value string, num double, cnt bigint)``;
    ``num`` is the numeric value for numeric columns, else null. Rows are
    grouped on typed keys (integral / floating / text), so these numbers are
    turned into strings only once per distinct value, after the shuffle.
    Decimals keep all their digits in ``value`` (``num`` is the nearest
    double); binary and nested values are counted by ``text_key``.
    """
    cols = list(cols) if cols is not None else df.columns
    schema = T.StructType(
        [
            T.StructField("column", T.StringType()),
            T.StructField("value", T.StringType()),
            T.StructField("num", T.DoubleType()),
            T.StructField("cnt", T.LongType()),
        ]
    )
    if not cols:
        return _spark(df).createDataFrame([], schema)
    items = []
    for c in cols:
        dt = field_type(df, c)
        ival = F.lit(None).cast("bigint")
        dval = F.lit(None).cast("double")
        sval = F.lit(None).cast("string")
        if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            ival = qcol(c).cast("bigint")
        elif isinstance(dt, T.DecimalType):
            sval, dval = qcol(c).cast("string"), qcol(c).cast("double")
        elif is_numeric(dt):
            dval = missing_safe(df, c).cast("double")
        else:
            sval = text_key(qcol(c), dt)
        items.append(F.struct(F.lit(c).alias("column"), sval.alias("s"), ival.alias("i"), dval.alias("d")))
    long = (
        df.select(F.explode(F.array(*items)).alias("kv"))
        .select("kv.*")
        .filter(F.col("s").isNotNull() | F.col("i").isNotNull() | F.col("d").isNotNull())
    )
    g = long.groupBy("column", "s", "i", "d").agg(F.count(F.lit(1)).alias("cnt"))
    return g.select(
        "column",
        F.coalesce(F.col("s"), F.col("i").cast("string"), F.col("d").cast("string")).alias("value"),
        F.coalesce(F.col("d"), F.col("i").cast("double")).alias("num"),
        "cnt",
    )


def top_values(vc: DataFrame, k: int, by_count: bool = True) -> DataFrame:
    """Top ``k`` values per column, ordered by (count desc, value asc) or,
    with ``by_count=False``, by (num asc, value asc). Adds ``rank`` (1-based)."""
    order = [F.desc("cnt"), F.asc("value")] if by_count else [F.asc_nulls_last("num"), F.asc("value")]
    w = Window.partitionBy("column").orderBy(*order)
    return vc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def modes(vc: DataFrame) -> DataFrame:
    """Most frequent value per column as a string; ties -> smallest string."""
    return top_values(vc, 1).select("column", F.col("value").alias("mode"), F.col("cnt").alias("mode_count"))


# --------------------------------------------------------------- quantiles
def quantiles_long(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    method: str = "exact",
    accuracy: int = 10000,
    hold: int = HOLD,
) -> DataFrame:
    """Linear-interpolated quantiles (pandas / ``quantile_cont``) as a long
    DataFrame ``(column, p_index, prob, value)``; NaN and null are skipped,
    columns without a value have no row.

    Exact by default, by selection over the raw rows (see
    :mod:`sparkprep.operators.quantiles`); ``hold`` bounds the rows read in
    its last aggregate and never changes the result. ``method="approx"`` uses
    ``percentile_approx`` (rank error about ``1/accuracy``).
    """
    spark = _spark(df)
    cols = [c for c in cols if is_numeric(field_type(df, c))]
    if not cols or not probs:
        return as_table(spark, [])
    values = {c: missing_safe(df, c).cast("double") for c in cols}
    if method != "approx":
        return as_table(spark, select(RawRows(df, values, accuracy), probs, hold))
    at = [float(p) for p in probs]
    items = [F.struct(F.lit(c).alias("column"), F.percentile_approx(x, at, accuracy).alias("vals")) for c, x in values.items()]
    parr = F.array(*[F.lit(p) for p in at])
    return (
        df.agg(F.array(*items).alias("a"))
        .select(F.explode("a").alias("s"))
        .select("s.column", F.posexplode("s.vals").alias("p_index", "value"))
        .select("column", F.col("p_index").cast("int"), F.element_at(parr, F.col("p_index") + 1).alias("prob"), "value")
    )


def quantiles_from_counts(counts: DataFrame, probs: Sequence[float], accuracy: int = 10000, hold: int = HOLD) -> DataFrame:
    """The same from ``(column, num, cnt)`` rows of distinct values, where a
    value-count table already exists. The table is read a few times, and kept
    for that time unless the caller keeps it."""
    if not probs:
        return as_table(_spark(counts), [])
    held = counts.is_cached
    if not held:
        counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return as_table(_spark(counts), select(CountedValues(counts, accuracy), probs, hold))
    finally:
        if not held:
            counts.unpersist()


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "exact", **kw
) -> dict[str, list[float | None]]:
    """Quantiles as a small driver-side dict ``{column: [v per prob]}``
    (bounded by columns x probs) for use as fitted literal state."""
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    if not cols:
        return out
    for r in quantiles_long(df, cols, probs, method=method, **kw).collect():
        out[r["column"]][r["p_index"]] = r["value"]
    return out


# ---------------------------------------------------------- distributed rank
def dense_codes(values: DataFrame, order: Sequence, partitions: int | None = None) -> DataFrame:
    """0-based dense codes of distinct ``(column, value, ...)`` rows within
    each column, in the given sort order, without a single-task window.

    Rows are range-partitioned on ``(column, *order)`` and sorted inside each
    partition; a row's position inside its partition comes from
    ``monotonically_increasing_id`` (record number in the low 33 bits). The
    ranked table is checkpointed (reliably, to the shared checkpoint folder)
    so positions cannot shift on recomputation; offsets come from a table of
    at most ``partitions + columns`` rows.
    """
    from sparkprep.session import ensure_checkpoint_dir

    spark = _spark(values)
    ensure_checkpoint_dir(spark)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("column"), *order]
    ranked = (
        values.repartitionByRange(p, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__pid", F.spark_partition_id())
        .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint(eager=True)
    )
    stats = ranked.groupBy("__pid", "column").agg(F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__p0"))
    w = Window.partitionBy("column").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.select("__pid", "column", "__p0", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    return (
        ranked.join(F.broadcast(offs), ["__pid", "column"])
        .withColumn("code", F.col("__off") + F.col("__pos") - F.col("__p0"))
        .drop("__pid", "__pos", "__p0", "__off")
    )


# ------------------------------------------------------------------ profile
def _dtype_name(dt: T.DataType) -> str:
    return dt.simpleString()


def _schema_frame(df: DataFrame) -> DataFrame:
    """Schema metadata as a tiny DataFrame (one row per column)."""
    rows = [
        (i, f.name, _dtype_name(f.dataType), is_numeric(f.dataType), is_text(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    return _spark(df).createDataFrame(
        rows, "position int, column string, dtype string, is_numeric boolean, is_text_like boolean"
    )


def numeric_summary_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One wide aggregate (count/mean/std/min/max per numeric column),
    exploded to one row per column without a driver round trip."""
    spark = _spark(df)
    if not cols:
        return spark.createDataFrame(
            [], "column string, count bigint, mean double, std double, std_pop double, min double, max double"
        )
    items = []
    for c in cols:
        x = missing_safe(df, c).cast("double")
        items.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.stddev_pop(x).alias("std_pop"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            )
        )
    return df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def profile(
    df: DataFrame,
    target_column: str | None = None,
    max_example_values: int = 5,
    quantile_method: str = "exact",
    approx: bool = False,
) -> DataFrame:
    """Per-column profile (reference ``build_dataset_profile``).

    Columns: position, column, dtype, missing_count, missing_ratio (6 dp),
    n_unique, sample_values (the ``max_example_values`` smallest distinct
    values as strings), is_numeric, is_text_like, is_constant, num_min,
    num_max, num_mean (6 dp), num_median (6 dp).
    """
    cols = df.columns
    sub = df.select(*[qcol(c) for c in cols])
    if approx:
        return _profile_approx(sub, cols, max_example_values)
    n_rows = sub.count()
    n = F.lit(n_rows)
    vc = value_counts_long(sub, cols).persist(StorageLevel.MEMORY_AND_DISK)
    num_cols = [c for c in cols if is_numeric(field_type(df, c))]
    per_col = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("cnt").alias("non_missing"))
    samples = (
        top_values(vc, max_example_values, by_count=False)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("s"))
        .select("column", F.transform("s", lambda x: x["value"]).alias("sample_values"))
    )
    nums = numeric_summary_long(sub, num_cols).select(
        "column",
        F.col("min").alias("num_min"),
        F.col("max").alias("num_max"),
        F.round("mean", 6).alias("num_mean"),
    )
    meta = _schema_frame(sub)
    out = meta.join(per_col, "column", "left").join(samples, "column", "left").join(nums, "column", "left")
    med = quantiles_long(sub, num_cols, [0.5], method=quantile_method)
    out = out.join(med.select("column", F.round("value", 6).alias("num_median")), "column", "left")
    nu = F.coalesce(F.col("n_unique"), F.lit(0))
    missing = n - F.coalesce(F.col("non_missing"), F.lit(0))
    return out.select(
        "position",
        "column",
        "dtype",
        missing.alias("missing_count"),
        F.round(F.try_divide(missing, n), 6).alias("missing_ratio"),
        nu.alias("n_unique"),
        F.coalesce(F.col("sample_values"), F.array().cast("array<string>")).alias("sample_values"),
        "is_numeric",
        "is_text_like",
        (nu <= 1).alias("is_constant"),
        F.when(F.col("is_numeric"), F.col("num_min")).alias("num_min"),
        F.when(F.col("is_numeric"), F.col("num_max")).alias("num_max"),
        F.when(F.col("is_numeric"), F.col("num_mean")).alias("num_mean"),
        F.when(F.col("is_numeric"), F.col("num_median")).alias("num_median"),
    )


def _hashable(df: DataFrame, c: str) -> Column:
    return canonical(qcol(c), field_type(df, c))


def _profile_approx(sub: DataFrame, cols: Sequence[str], k: int, accuracy: int = 10000) -> DataFrame:
    """Scale mode: no full value-count shuffle. One wide aggregate gives
    missing counts, HyperLogLog distinct counts, min/max/mean and
    ``percentile_approx`` medians; samples are the ``k`` smallest distinct
    values via a ``dense_rank <= k`` window, which Spark limits map-side."""
    items = []
    for c in cols:
        dt = field_type(sub, c)
        x = missing_safe(sub, c)
        num = is_numeric(dt)
        xd = x.cast("double") if num else F.lit(None).cast("double")
        items.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(is_missing(sub, c)).alias("missing_count"),
                F.approx_count_distinct(_hashable(sub, c)).alias("n_unique"),
                (F.min(xd) if num else F.lit(None).cast("double")).alias("num_min"),
                (F.max(xd) if num else F.lit(None).cast("double")).alias("num_max"),
                (F.round(F.avg(xd), 6) if num else F.lit(None).cast("double")).alias("num_mean"),
                (F.round(F.percentile_approx(xd, 0.5, accuracy), 6) if num else F.lit(None).cast("double")).alias("num_median"),
                F.count(F.lit(1)).alias("n"),
            )
        )
    stats = sub.agg(F.array(*items).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    long = sub.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        text_key(missing_safe(sub, c), field_type(sub, c)).alias("value"),
                        (missing_safe(sub, c).cast("double") if is_numeric(field_type(sub, c)) else F.lit(None).cast("double")).alias("num"),
                    )
                    for c in cols
                ]
            )
        ).alias("kv")
    ).select("kv.*").filter(F.col("value").isNotNull())
    # distinct (column, value) pairs meet after a map-side combine, so a heavy value is one row for each task
    w = Window.partitionBy("column").orderBy(F.asc_nulls_last("num"), F.asc("value"))
    samples = (
        long.groupBy("column", "num", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("r", F.row_number().over(w))
        .filter(F.col("r") <= k)
        .select("column", "r", "value")
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("r", "value"))).alias("sv"))
        .select("column", F.transform("sv", lambda x: x["value"]).alias("sample_values"))
    )
    meta = _schema_frame(sub)
    out = meta.join(stats, "column", "left").join(samples, "column", "left")
    return out.select(
        "position",
        "column",
        "dtype",
        "missing_count",
        F.round(F.try_divide(F.col("missing_count"), F.col("n")), 6).alias("missing_ratio"),
        "n_unique",
        F.coalesce(F.col("sample_values"), F.array().cast("array<string>")).alias("sample_values"),
        "is_numeric",
        "is_text_like",
        (F.col("n_unique") <= 1).alias("is_constant"),
        "num_min",
        "num_max",
        "num_mean",
        "num_median",
    )


def target_profile(df: DataFrame, target_column: str) -> DataFrame:
    """Class counts of the stringified target, missing included as a class
    (``nan`` for floating targets, ``None`` otherwise)."""
    label = "nan" if is_float(field_type(df, target_column)) else "None"
    cls = F.when(is_missing(df, target_column), F.lit(label)).otherwise(F.col(target_column).cast("string"))
    return df.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("count"))


def profile_dict(df: DataFrame, target_column: str | None = None, **kw) -> dict:
    """The profile as the reference's nested dict (small: one entry per column)."""
    rows = profile(df, target_column, **kw).orderBy("position").collect()
    cols = []
    for r in rows:
        d = r.asDict()
        summary = None
        if d["is_numeric"] and d["num_min"] is not None:
            summary = {"min": d["num_min"], "max": d["num_max"], "mean": d["num_mean"], "median": d["num_median"]}
        cols.append(
            {
                "name": d["column"],
                "dtype": d["dtype"],
                "missing_count": int(d["missing_count"]),
                "missing_ratio": float(d["missing_ratio"] or 0.0),
                "n_unique": int(d["n_unique"]),
                "sample_values": list(d["sample_values"]),
                "is_numeric": bool(d["is_numeric"]),
                "is_text_like": bool(d["is_text_like"]),
                "is_constant": bool(d["is_constant"]),
                "numeric_summary": summary,
            }
        )
    out = {"n_rows": df.count(), "n_cols": len(df.columns), "columns": cols, "target_profile": None}
    if target_column and target_column in df.columns:
        tp = {r["class"]: int(r["count"]) for r in target_profile(df, target_column).collect()}
        n_unique = next((c["n_unique"] for c in cols if c["name"] == target_column), 0)
        miss = next((c["missing_count"] for c in cols if c["name"] == target_column), 0)
        out["target_profile"] = {
            "target_column": target_column,
            "class_counts": tp,
            "n_unique": n_unique,
            "missing_count": miss,
        }
    return out


# ----------------------------------------------------- overview / describe
def missing_count_exprs(df: DataFrame, cols: Iterable[str] | None = None) -> list[Column]:
    cols = list(cols) if cols is not None else df.columns
    return [F.sum(is_missing(df, c).cast("long")).alias(c) for c in cols]


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, total missing cells, duplicate rows, text columns.

    One scan for the totals and one for fingerprints of the rows; only rows
    with a repeated fingerprint are compared (nested columns included).
    """
    from sparkprep.operators.distinct import copies

    n_text = sum(1 for c in df.columns if is_text(field_type(df, c)))
    missing = sum((is_missing(df, c).cast("long") for c in df.columns), F.lit(0).cast("long"))
    totals = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("total_missing"))
    more = copies(df).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    parts = totals.unionByName(more, allowMissingColumns=True)  # a row of each
    return parts.agg(
        F.max("rows").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.max("total_missing").alias("total_missing"),
        F.max("duplicate_rows").alias("duplicate_rows"),
        F.lit(n_text).alias("categorical_columns"),
    )


def column_types(
    df: DataFrame, count_missing_as_unique: bool = False, approx: bool = False, rsd: float = 0.02
) -> DataFrame:
    """Column, dtype, missing, missing % (1 dp), n_unique.

    ``approx=True`` is one pass without a shuffle of values: missing counts
    stay exact, ``n_unique`` is a HyperLogLog estimate with relative
    standard deviation ``rsd``."""
    cols = df.columns
    if approx:
        items = [
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(is_missing(df, c)).alias("missing"),
                F.approx_count_distinct(_hashable(df, c), rsd).alias("nu"),
                F.count(F.lit(1)).alias("n"),
            )
            for c in cols
        ]
        st = df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("s")).select("s.*")
        meta = _schema_frame(df.select(*[qcol(c) for c in cols]))
        nu = F.col("nu") + (F.when(F.col("missing") > 0, 1).otherwise(0) if count_missing_as_unique else F.lit(0))
        return meta.join(st, "column", "left").select(
            "position",
            "column",
            "dtype",
            "missing",
            F.round(F.lit(100.0) * F.col("missing") / F.greatest(F.col("n"), F.lit(1)), 1).alias("missing_pct"),
            nu.alias("n_unique"),
        )
    n = df.count()
    vc = value_counts_long(df, cols)
    per_col = vc.groupBy("column").agg(F.count(F.lit(1)).alias("nu"), F.sum("cnt").alias("nm"))
    meta = _schema_frame(df.select(*[qcol(c) for c in cols]))
    missing = F.lit(n) - F.coalesce(F.col("nm"), F.lit(0))
    nu = F.coalesce(F.col("nu"), F.lit(0))
    if count_missing_as_unique:
        nu = nu + F.when(missing > 0, 1).otherwise(0)
    return meta.join(per_col, "column", "left").select(
        "position",
        "column",
        "dtype",
        missing.alias("missing"),
        F.round(F.lit(100.0) * missing / F.lit(max(n, 1)), 1).alias("missing_pct"),
        nu.alias("n_unique"),
    )


def describe(df: DataFrame, quantile_method: str = "exact") -> DataFrame:
    """``describe(include="all")`` in long form: count, unique, top, freq
    (text/other columns), mean, std (ddof 1), min, q25, q50, q75, max
    (numeric columns)."""
    cols = df.columns
    sub = df.select(*[qcol(c) for c in cols])
    num_cols = [c for c in cols if is_numeric(field_type(df, c))]
    vc = value_counts_long(sub, cols).persist(StorageLevel.MEMORY_AND_DISK)
    per_col = vc.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), F.sum("cnt").alias("count"))
    top = modes(vc).select("column", F.col("mode").alias("top"), F.col("mode_count").alias("freq"))
    nums = numeric_summary_long(sub, num_cols).select("column", "mean", "std", "min", "max")
    meta = _schema_frame(sub)
    out = meta.join(per_col, "column", "left").join(top, "column", "left").join(nums, "column", "left")
    ql = quantiles_long(sub, num_cols, [0.25, 0.5, 0.75], method=quantile_method)
    q = ql.groupBy("column").agg(
        *[F.max(F.when(F.col("p_index") == i, F.col("value"))).alias(nm) for i, nm in enumerate(["q25", "q50", "q75"])]
    )
    out = out.join(q, "column", "left")
    isnum = F.col("is_numeric")
    return out.select(
        "position",
        "column",
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        F.when(~isnum, F.coalesce(F.col("unique"), F.lit(0))).alias("unique"),
        F.when(~isnum, F.col("top")).alias("top"),
        F.when(~isnum, F.col("freq")).alias("freq"),
        "mean",
        "std",
        "min",
        "q25",
        "q50",
        "q75",
        "max",
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """``(column, missing)`` for every column, from one wide aggregate."""
    cols = df.columns
    items = [F.struct(F.lit(c).alias("column"), F.sum(is_missing(df, c).cast("long")).alias("missing")) for c in cols]
    return df.agg(F.array(*items).alias("a")).select(F.explode("a").alias("s")).select(
        "s.column", F.coalesce(F.col("s.missing"), F.lit(0)).alias("missing")
    )


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Before/after report: ``(section, name, before, after)``.

    Sections: ``dataset`` (rows, columns, missing, duplicates),
    ``missing_by_column`` (columns with any missing on either side, full
    outer joined by name) and ``schema`` (added / removed columns)."""
    spark = _spark(before)
    ob, oa = overview(before), overview(after)

    def dataset_rows(o: DataFrame, side: str) -> DataFrame:
        return o.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(m).alias("name"), F.col(src).cast("long").alias(side))
                        for m, src in [
                            ("rows", "rows"),
                            ("columns", "columns"),
                            ("missing", "total_missing"),
                            ("duplicates", "duplicate_rows"),
                        ]
                    ]
                )
            ).alias("s")
        ).select("s.*")

    ds = dataset_rows(ob, "before").join(dataset_rows(oa, "after"), "name").withColumn("section", F.lit("dataset"))
    mb = missing_by_column(before).withColumnRenamed("missing", "before")
    ma = missing_by_column(after).withColumnRenamed("missing", "after")
    mc = (
        mb.join(ma, "column", "full_outer")
        .filter((F.coalesce("before", F.lit(0)) > 0) | (F.coalesce("after", F.lit(0)) > 0))
        .select(F.lit("missing_by_column").alias("section"), F.col("column").alias("name"), "before", "after")
    )
    added = [c for c in after.columns if c not in before.columns]
    removed = [c for c in before.columns if c not in after.columns]
    sch = spark.createDataFrame(
        [("schema", c, 0, 1) for c in added] + [("schema", c, 1, 0) for c in removed],
        "section string, name string, before bigint, after bigint",
    )
    return ds.select("section", "name", "before", "after").unionByName(mc).unionByName(sch)


# -------------------------------------------------------------- correlation
#: Co-moments of a pair (x, y) over the rows that have both: count, means, centred sums of squares and of products.
MOMENTS = ("n", "mx", "my", "sxx", "syy", "sxy")
#: Parts in which the tasks' co-moments of one column are merged before they meet.
MOMENT_PARTS = 64


def _merge_moments(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The co-moments of both sets of rows, by the pairwise formula. Equal means add exactly nothing."""
    n = a["n"] + b["n"]
    share = np.divide(b["n"], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, weight = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * share
    first = a["n"] == 0  # nothing to move from
    return {
        "n": n,
        "mx": np.where(first, b["mx"], a["mx"] + dx * share),
        "my": np.where(first, b["my"], a["my"] + dy * share),
        "sxx": a["sxx"] + b["sxx"] + dx * dx * weight,
        "syy": a["syy"] + b["syy"] + dy * dy * weight,
        "sxy": a["sxy"] + b["sxy"] + dx * dy * weight,
    }


def _batch_moments(values: np.ndarray) -> dict[str, np.ndarray]:
    """Co-moments of all pairs of columns over one batch: rows with the same columns missing are centred together."""
    p = values.shape[1]
    total = {m: np.zeros((p, p)) for m in MOMENTS}
    seen = ~np.isnan(values)
    patterns, of = np.unique(np.packbits(seen, axis=1), axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    for rows in np.split(order, np.cumsum(np.bincount(of.ravel(), minlength=len(patterns)))[:-1]):
        here = seen[rows[0]] if len(rows) else np.zeros(p, bool)
        if not here.any():
            continue
        x = values[np.ix_(rows, here)]
        middle = x[0] + (x - x[0]).mean(0)
        x = x - middle
        left = x.mean(0)  # what rounding left of the mean; exactly 0 in a constant column
        products = x.T @ x - len(rows) * np.outer(left, left)
        mean, squares = middle + left, np.diag(products)
        own = {m: np.zeros((p, p)) for m in MOMENTS}
        both = np.ix_(here, here)
        own["n"][both] = len(rows)
        own["mx"][both], own["my"][both] = mean[:, None], mean[None, :]
        own["sxx"][both], own["syy"][both] = squares[:, None], squares[None, :]
        own["sxy"][both] = products
        total = _merge_moments(total, own)
    return total


def corr_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation of every pair ``i < j`` as
    ``(col_a, col_b, corr)``; null where undefined.

    One scan: every task merges the centred co-moments of its Arrow batches
    and gives one row of arrays for each column; these rows are merged in
    parts, then for each column, so neither what is shuffled nor what one
    task reads grows with the rows. Centring by pair keeps digits where
    values are large or a row's partner is missing, and gives a constant
    column exactly zero spread."""
    spark = _spark(df)
    p = len(cols)
    if p < 2:
        return spark.createDataFrame([], "col_a string, col_b string, corr double")
    x = [missing_safe(df, c).cast("double") for c in cols]
    schema = "i int, part int, " + ", ".join(f"{m} array<double>" for m in MOMENTS)

    def rows_of(i, parts, moments: list[dict[str, np.ndarray]]):
        arrays = [pa.array([m[name].tolist() for m in moments], pa.list_(pa.float64())) for name in MOMENTS]
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(parts, pa.int32()), *arrays], names=["i", "part", *MOMENTS])

    def moments_of(batches):
        total = {m: np.zeros((p, p)) for m in MOMENTS}
        for batch in batches:
            if batch.num_rows:
                values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                total = _merge_moments(total, _batch_moments(values))
        part = TaskContext.get().partitionId() % MOMENT_PARTS
        yield rows_of(range(p), [part] * p, [{m: total[m][i] for m in MOMENTS} for i in range(p)])

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for row in zip(*[table.column(m).to_pylist() for m in MOMENTS]):
            own = dict(zip(MOMENTS, map(np.array, row)))
            total = own if total is None else _merge_moments(total, own)
        return pa.Table.from_batches([rows_of([table.column("i")[0].as_py()], [0], [total])])

    parts = df.select(*[v.alias(f"c{i}") for i, v in enumerate(x)]).mapInArrow(moments_of, schema)
    whole = parts.groupBy("i", "part").applyInArrow(merge, schema).groupBy("i").applyInArrow(merge, schema)
    corr = F.transform(
        F.arrays_zip("sxx", "syy", "sxy"),
        lambda m: F.try_divide(m["sxy"], F.sqrt(F.greatest(m["sxx"], F.lit(0.0))) * F.sqrt(F.greatest(m["syy"], F.lit(0.0)))),
    )
    pairs = whole.select("i", F.posexplode(corr).alias("j", "corr")).where("i < j")
    names = F.array(*[F.lit(c) for c in cols])
    return pairs.select(F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), "corr")
