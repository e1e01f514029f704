"""Row-set operators: drop rows with missing values (O14), deduplicate
(O19-O21).

Deduplication never sorts a whole key group in one task: ``keep=first/last``
is a ``min`` / ``max`` over one struct (``order_by`` columns first, then the
rest of the row as tie-break), or ``min_by`` / ``max_by`` when a column is
not orderable; ``keep=none`` is a count plus ``any_value``. All have map-side
partial aggregation, so a key holding a third of all rows is reduced before
the shuffle. Whole rows are compared by fingerprints first
(:mod:`sparkprep.operators.distinct`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.missing import field_type, is_missing, is_text, missing_safe, qcol
from sparkprep.operators.base import Result, lazy, require_columns
from sparkprep.operators.distinct import distinct_rows
from sparkprep.operators.profile import atomic_columns


def drop_missing_rows(df: DataFrame, columns: Sequence[str]) -> Result:
    """Drop rows where any listed column is missing (null or NaN)."""
    require_columns(df, columns, "handle_missing")
    any_missing = F.lit(False)
    for c in columns:
        any_missing = any_missing | is_missing(df, c)
    out = df.filter(~any_missing)

    def audit():
        n = df.agg(F.count_if(any_missing).alias("d")).first()["d"]
        return {"dropped_rows": int(n)}, []

    return lazy(out, audit)


def _key_exprs(df: DataFrame, subset: Sequence[str], case_insensitive: bool):
    keys = []
    for i, c in enumerate(subset):
        e = missing_safe(df, c)
        if case_insensitive and is_text(field_type(df, c)):
            e = F.lower(e)
        keys.append(e.alias(f"__k{i}"))
    return keys


def deduplicate(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str = "first",
    case_insensitive: bool = False,
    order_by: Sequence[str] | None = None,
) -> Result:
    """Remove duplicate rows. Missing equals missing.

    ``subset=None`` compares whole rows. With a subset, ``keep="first"`` /
    ``"last"`` keeps the row with the smallest / largest ``order_by`` tuple
    (Spark has no row order; the whole row breaks ties deterministically).
    ``keep="none"`` drops every member of a duplicated group.
    """
    if keep not in {"first", "last", "none"}:
        raise ValueError("deduplicate 'keep' must be one of: first | last | none")
    if subset is not None:
        if not isinstance(subset, (list, tuple)) or len(subset) == 0:
            raise ValueError("deduplicate 'subset' must be a non-empty list or None")
        require_columns(df, subset, "deduplicate")
    if order_by:
        require_columns(df, order_by, "deduplicate")
    cols = df.columns
    row = F.struct(*[qcol(c) for c in cols]).alias("__row")

    if subset is None:
        out = distinct_rows(df, keep_copied=keep != "none")
        examples = None
    else:
        keys = _key_exprs(df, subset, case_insensitive)
        knames = [f"__k{i}" for i in range(len(subset))]
        keyed = df.select(*keys, row)
        if keep == "none":
            g = keyed.groupBy(*knames).agg(F.count(F.lit(1)).alias("__n"), F.any_value("__row").alias("__row"))
            out = g.filter(F.col("__n") == 1).select("__row.*")
        else:
            ordered = list(order_by or [])
            atomic = atomic_columns(df)
            if len(atomic) == len(cols):
                # every column is orderable: one struct (order_by first, then
                # the rest of the row as tie-break) carries the row once
                rest = [c for c in cols if c not in ordered]
                packed = F.struct(*[qcol(c).alias(f"__o{i}") for i, c in enumerate(ordered)], *[qcol(c) for c in rest])
                agg = F.min if keep == "first" else F.max
                g = df.select(*keys, packed.alias("__p")).groupBy(*knames).agg(agg("__p").alias("__p"))
                names = {c: f"__p.__o{i}" for i, c in enumerate(ordered)}
                out = g.select(*[F.col(names.get(c, f"__p.`{c}`")).alias(c) for c in cols])
            else:
                tie = [qcol(c) for c in ordered] + [qcol(c) for c in atomic]
                keyed = df.select(*keys, row, F.struct(*tie).alias("__ord"))
                pick = F.min_by if keep == "first" else F.max_by
                out = keyed.groupBy(*knames).agg(pick("__row", "__ord").alias("__row")).select("__row.*")
        examples = (
            df.select(*keys)
            .groupBy(*knames)
            .count()
            .filter(F.col("count") > 1)
            .orderBy(*knames)
            .limit(3)
        )

    def audit():
        before = df.count()
        after = out.count()
        diff = {
            "subset": list(subset) if subset is not None else None,
            "keep": keep,
            "case_insensitive": case_insensitive,
            "rows_before": before,
            "rows_after": after,
            "rows_removed": before - after,
        }
        warnings = [] if before != after else ["No duplicate rows were found for the given configuration."]
        if examples is not None and before != after:
            diff["duplicate_key_examples"] = [
                {c: r[f"__k{i}"] for i, c in enumerate(subset)} for r in examples.collect()
            ]
        return diff, warnings

    return lazy(out, audit)


def duplicate_key_examples(
    df: DataFrame, subset: Sequence[str], case_insensitive: bool = False, n: int = 3
) -> DataFrame:
    """The ``n`` smallest duplicated keys (after case folding) and their
    multiplicity; a top-k report."""
    keys = _key_exprs(df, subset, case_insensitive)
    knames = [f"__k{i}" for i in range(len(subset))]
    g = df.select(*keys).groupBy(*knames).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    return g.orderBy(*knames).limit(n).select(*[F.col(k).alias(c) for k, c in zip(knames, subset)], "n_rows")
