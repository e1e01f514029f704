"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.missing import NUMBER, qcol

# pandas' default missing-value markers (keep_default_na=True).
DEFAULT_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
SEPARATORS = [",", ";", "\t", "|"]
ENCODINGS = ["utf-8", "latin-1", "cp1252", "utf-16"]
# Spark's CSV reader takes canonical charset names only.
_CHARSET = {"utf-8": "utf-8", "utf8": "utf-8", "latin-1": "iso-8859-1", "latin1": "iso-8859-1",
            "iso-8859-1": "iso-8859-1", "cp1252": "windows-1252", "windows-1252": "windows-1252",
            "utf-16": "utf-16", "utf-16le": "utf-16le", "utf-16be": "utf-16be"}
_SPARK_CHARSETS = {"iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8"}


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    encoding: str = "utf-8",
    na_values: Sequence[str] | None = None,
    keep_default_na: bool = True,
    infer_types: bool = True,
    schema: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with pandas-style missing markers: every cell in the marker set
    (defaults plus ``na_values``) becomes null, then column types are
    inferred by Spark over the cleaned strings (or ``schema`` is applied).
    Quotes inside a quoted cell are doubled, and a cell may hold line feeds;
    with ``multi_line=False`` it may not, and large files are split among
    tasks. A row with more or fewer cells than the header is an error."""
    if sep not in SEPARATORS and len(sep) != 1:
        raise ValueError(f"unsupported separator {sep!r}")
    markers = list(DEFAULT_NA_VALUES if keep_default_na else []) + list(na_values or [])
    charset = _CHARSET.get(encoding.lower(), encoding.lower())
    if charset not in _SPARK_CHARSETS:
        # other Java charsets (e.g. windows-1252) need Spark's legacy switch
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", charset)
        .option("inferSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    cleaned = raw.select(*[F.when(qcol(c).isin(markers), None).otherwise(qcol(c)).alias(c) for c in raw.columns])
    if schema:
        return cleaned.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], schema).schema.fields])
    if not infer_types:
        return cleaned
    return _infer(cleaned)


def _infer(df: DataFrame) -> DataFrame:
    """Promote string columns to bigint / double / boolean when every
    non-null value parses (one aggregate over the table)."""
    checks = []
    for c in df.columns:
        x = qcol(c)
        checks += [
            F.count_if(x.isNotNull() & x.try_cast("bigint").isNull()).alias(f"i::{c}"),
            F.count_if(x.isNotNull() & (x.try_cast("double").isNull() | ~x.rlike(NUMBER))).alias(f"d::{c}"),
            F.count_if(x.isNotNull() & ~F.lower(x).isin("true", "false")).alias(f"b::{c}"),
            F.count(x).alias(f"n::{c}"),
        ]
    row = df.agg(*checks).first()
    out = []
    for c in df.columns:
        if row[f"n::{c}"] == 0:
            out.append(qcol(c).cast("double").alias(c))
        elif row[f"i::{c}"] == 0:
            out.append(qcol(c).cast("bigint").alias(c))
        elif row[f"d::{c}"] == 0:
            out.append(qcol(c).cast("double").alias(c))
        elif row[f"b::{c}"] == 0:
            out.append(F.lower(qcol(c)).cast("boolean").alias(c))
        else:
            out.append(qcol(c))
    return df.select(*out)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def preview(df: DataFrame, n: int = 20, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in a deterministic order (top-k, not a full sort)."""
    keys = list(order_by or df.columns)
    return df.orderBy(*[qcol(k) for k in keys]).limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write CSV (with header), JSON or Parquet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        # keep values verbatim (Spark's CSV writer trims by default)
        w.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
