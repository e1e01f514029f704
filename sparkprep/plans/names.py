"""Column names in plans: matched as written, else by their normalised form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sparkprep.operators.schema import resolve_column

LISTS = ("columns", "subset", "order_by", "exclude_columns", "drop_columns")
KEYED = ("column_encodings", "column_fills")


def resolve_names(df: DataFrame, names: Sequence[str] | None) -> list[str]:
    """Each name as the table has it; a name that it doesn't have in any form stays."""
    return [resolve_column(df, n) or n for n in names or []]


def resolve_params(df: DataFrame, params: dict) -> dict:
    out = dict(params)
    for key in LISTS:
        if isinstance(out.get(key), (list, tuple)):
            out[key] = resolve_names(df, out[key])
    for key in KEYED:
        if isinstance(out.get(key), dict):
            out[key] = {resolve_column(df, n) or n: v for n, v in out[key].items()}
    return out
