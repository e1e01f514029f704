"""Missing-value contract and column-type predicates.

A value is *missing* when it is null, or NaN in a float/double column: the
reference treats both the same way, Spark does not (``count`` counts NaN,
``max`` returns NaN), so every aggregate goes through :func:`missing_safe`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: A number as text. Spark's casts also read Java's forms "1D" and "2f", which are text here.
NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity|nan)\s*$"


def qcol(name: str) -> Column:
    """Column by exact name (spaces, dots and hyphens allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_bool(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_numeric(dt: T.DataType) -> bool:
    """Numeric for the operators: any NumericType, never boolean."""
    return isinstance(dt, T.NumericType)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_missing(df: DataFrame, name: str) -> Column:
    """``c IS NULL`` or, for floating columns, ``isnan(c)`` as well."""
    c = qcol(name)
    if is_float(field_type(df, name)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_safe(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so aggregates skip it."""
    c = qcol(name)
    if is_float(field_type(df, name)):
        return F.nanvl(c, F.lit(None).cast(field_type(df, name)))
    return c


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in ex and is_numeric(f.dataType)]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in ex and is_text(f.dataType)]


def to_double(text: Column) -> Column:
    """A text as a double, null where it is no number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def canonical(value: Column, dt: T.DataType) -> Column:
    """A key that can be grouped and is equal for equal values of any type: NaN is missing, a map's entries are sorted."""
    if is_float(dt):
        return F.when(~F.isnan(value), value + F.lit(0))  # -0.0 becomes 0.0
    if isinstance(dt, T.ArrayType):
        return F.transform(value, lambda v: canonical(v, dt.elementType))
    if isinstance(dt, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[canonical(value[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(dt.fields)]))
    if isinstance(dt, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(canonical(e["key"], dt.keyType).alias("k"), canonical(e["value"], dt.valueType).alias("v")))
        return F.array_sort(entries)
    return value


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ArrayType, T.StructType, T.MapType))


def text_key(value: Column, dt: T.DataType) -> Column:
    """A text that is equal exactly for equal values of one type, null where
    the value is missing: bytes as hexadecimal digits, nested values as JSON
    of their canonical form with all fields and whole timestamps, all others
    as Spark writes them (decimals with all digits)."""
    if is_nested(dt):
        whole = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
        options = {"ignoreNullFields": "false", "timestampFormat": whole, "timestampNTZFormat": whole}
        return F.when(value.isNotNull(), F.to_json(canonical(value, dt), options))
    if isinstance(dt, T.BinaryType):
        return F.hex(value)
    if is_float(dt):
        value = canonical(value, dt)
    return value.cast("string")
