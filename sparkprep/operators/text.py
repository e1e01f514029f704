"""``normalize_text`` (O17): strip -> lower -> remove accents -> collapse
whitespace -> ordered regex replacements -> null-like values to null, in
that fixed order, as one projection of native string expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.missing import field_type, is_missing, is_text, qcol
from sparkprep.functions.text import (
    py_collapse_whitespace,
    py_strip,
    python_pattern_to_java,
    python_repl_to_java,
    remove_accents,
)
from sparkprep.operators.base import Result, lazy, require_columns

ALLOWED_OPS = ("strip", "lower", "remove_accents", "collapse_whitespace")


def _validate(ops, replace, null_like, non_string_policy):
    if not isinstance(ops, (list, tuple)):
        raise ValueError("normalize_text 'ops' must be a list")
    for op in ops:
        if op not in ALLOWED_OPS:
            raise ValueError(f"normalize_text op '{op}' is not supported")
    if replace and not isinstance(replace, (list, tuple)):
        raise ValueError("normalize_text 'replace' must be a list of {pattern,repl}")
    for rule in replace or []:
        if not isinstance(rule.get("pattern"), str):
            raise ValueError("normalize_text replace rule missing 'pattern' string")
    if null_like and not isinstance(null_like, (list, tuple)):
        raise ValueError("normalize_text 'null_like_to_nan' must be a list of strings")
    if non_string_policy not in {"coerce_to_string", "skip"}:
        raise ValueError("normalize_text 'non_string_policy' must be 'coerce_to_string' or 'skip'")


def text_steps(c: Column, ops: Sequence[str], replace: Sequence[dict] | None) -> tuple[Column, list[tuple[Column, Column]]]:
    """Fixed-order pipeline; also returns each regex rule's (before, after)."""
    if "strip" in ops:
        c = py_strip(c)
    if "lower" in ops:
        c = F.lower(c)
    if "remove_accents" in ops:
        c = remove_accents(c)
    if "collapse_whitespace" in ops:
        c = py_collapse_whitespace(c)
    rule_pairs = []
    for rule in replace or []:
        new = F.regexp_replace(c, python_pattern_to_java(rule["pattern"]), python_repl_to_java(rule.get("repl", "")))
        rule_pairs.append((c, new))
        c = new
    return c, rule_pairs


def normalize_text(
    df: DataFrame,
    columns: Sequence[str],
    ops: Sequence[str] = ("strip", "lower", "collapse_whitespace"),
    replace: Sequence[dict] | None = None,
    null_like_to_nan: Sequence[str] | None = None,
    non_string_policy: str = "coerce_to_string",
) -> Result:
    """Normalise text columns; non-string columns are cast to string
    (``coerce_to_string``) or left untouched (``skip``).

    Audit (one aggregate, on demand): values changed per column (both sides
    non-null and different; null-like conversions are not counted),
    null-like conversions and regex rules that changed a value.
    """
    if not columns or not isinstance(columns, (list, tuple)):
        raise ValueError("normalize_text requires 'columns' as a non-empty list")
    ops = list(ops)
    _validate(ops, replace, null_like_to_nan, non_string_policy)
    require_columns(df, columns, "normalize_text")
    nl = [str(x).lower() for x in (null_like_to_nan or [])]

    plan = {}
    for name in columns:
        if non_string_policy == "skip" and not is_text(field_type(df, name)):
            continue
        base = F.when(~is_missing(df, name), qcol(name).cast("string"))  # a missing value stays missing
        stepped, pairs = text_steps(base, ops, replace)
        final = stepped
        if nl:
            final = F.when(F.lower(stepped).isin(nl), F.lit(None).cast("string")).otherwise(stepped)
        plan[name] = (base, stepped, pairs, final)

    out = df.select(*[plan[c][3].alias(c) if c in plan else qcol(c) for c in df.columns])

    def audit():
        aggs = []
        for name, (base, stepped, pairs, final) in plan.items():
            aggs.append(F.count_if(base.isNotNull() & final.isNotNull() & (base != final)).alias(f"chg::{name}"))
            if nl:
                aggs.append(F.count_if(stepped.isNotNull() & F.lower(stepped).isin(nl)).alias(f"nl::{name}"))
            if pairs:
                per_row = sum((F.when(b != a, 1).otherwise(0) for b, a in pairs), F.lit(0))
                aggs.append(F.sum(per_row).alias(f"rep::{name}"))
        row = df.agg(*aggs).first().asDict() if aggs else {}
        diff = {
            "columns_normalized": list(plan),
            "values_changed_count": {},
            "null_like_converted_to_nan": {},
            "replacements_applied": {},
        }
        warnings = []
        for name in plan:
            n = int(row.get(f"chg::{name}") or 0)
            diff["values_changed_count"][name] = n
            if n == 0:
                warnings.append(f"normalize_text: no values changed in column '{name}'")
            if row.get(f"nl::{name}"):
                diff["null_like_converted_to_nan"][name] = int(row[f"nl::{name}"])
            if row.get(f"rep::{name}"):
                diff["replacements_applied"][name] = int(row[f"rep::{name}"])
        return diff, warnings

    return lazy(out, audit, state={"cols": list(plan), "ops": ops, "replace": list(replace or []), "null_like_to_nan": list(null_like_to_nan or [])})


def changes_by_column(df: DataFrame, columns: Sequence[str], **params) -> DataFrame:
    """The normalisation audit as a DataFrame ``(column, values_changed,
    null_like_converted, replacements_applied)`` (one aggregate)."""
    res = normalize_text(df, list(columns), **params)
    d = res.diff
    rows = [
        (c, d["values_changed_count"].get(c, 0), d["null_like_converted_to_nan"].get(c, 0), d["replacements_applied"].get(c, 0))
        for c in d["columns_normalized"]
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, values_changed bigint, null_like_converted bigint, replacements_applied bigint"
    )
