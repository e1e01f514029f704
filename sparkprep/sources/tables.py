"""Test-table loading and the *dirty views* used by queries and oracles.

The driver tables contain no nulls, so the operator queries start from views
that null out or garble some values. The SQL text is shared verbatim with the
DuckDB oracle (backticks become double quotes there); it only prepares input
rows and does none of an operator's work.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]

DIRTY_VIEWS: dict[str, str] = {
    "dirty_lineitem": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
 CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
 l_discount, l_tax,
 CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
 l_linestatus FROM lineitem""",
    "dirty_customer": """
SELECT c_custkey, c_name AS `Customer Name`, c_nationkey AS `Nation-Key`,
 CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
 CASE WHEN c_custkey % 17 = 0 THEN 'N/A' WHEN c_custkey % 13 = 0 THEN NULL
      WHEN c_custkey % 5 = 0 THEN '  ' || upper(c_mktsegment) || '  '
      WHEN c_custkey % 5 = 1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment
 FROM customer""",
    "dirty_orders": """
SELECT o_orderkey, o_custkey,
 CASE WHEN o_orderkey % 13 = 0 THEN 'bad' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS price_txt,
 CASE WHEN o_orderkey % 19 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date_txt,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
 o_orderstatus, o_totalprice FROM orders""",
    "leaky_orders": """
SELECT o_orderkey, o_totalprice, o_totalprice * 2.0 AS leak_linear, o_orderstatus,
 o_orderstatus AS o_orderstatus_copy, 1 AS const_col,
 CASE WHEN o_orderkey % 500 = 0 THEN 'x' ELSE 'y' END AS near_const FROM orders""",
    "labelled_documents": """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    for n in names or TABLES:
        path = os.path.join(sf_dir, f"{n}.parquet")
        if os.path.exists(path) or "://" in sf_dir:
            table(spark, sf_dir, n).createOrReplaceTempView(n)


# base tables each dirty view reads
VIEW_TABLES = {
    "dirty_lineitem": ["lineitem"],
    "dirty_customer": ["customer"],
    "dirty_orders": ["orders"],
    "leaky_orders": ["orders"],
    "labelled_documents": ["documents", "labels"],
}


def dirty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dirty view as a DataFrame (registers only the base tables it reads)."""
    register_tables(spark, sf_dir, VIEW_TABLES[name])
    return spark.sql(DIRTY_VIEWS[name])


def duckdb_sql(name: str) -> str:
    """The same view text in DuckDB's dialect."""
    return DIRTY_VIEWS[name].replace("`", '"').replace("AS STRING", "AS VARCHAR")
