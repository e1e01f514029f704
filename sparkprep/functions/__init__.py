"""Column-level helpers shared by every operator (all JVM-side expressions)."""

from sparkprep.functions.missing import (
    field_type,
    is_bool,
    is_datetime,
    is_float,
    is_missing,
    is_numeric,
    is_text,
    missing_safe,
    numeric_columns,
    qcol,
    text_columns,
)
from sparkprep.functions.stats import adjusted_skew, safe_corr, severity_from_ratio

__all__ = [
    "field_type",
    "is_bool",
    "is_datetime",
    "is_float",
    "is_missing",
    "is_numeric",
    "is_text",
    "missing_safe",
    "numeric_columns",
    "qcol",
    "text_columns",
    "adjusted_skew",
    "safe_corr",
    "severity_from_ratio",
]
