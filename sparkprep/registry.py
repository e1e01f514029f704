"""Registered queries (one per operator) and their DuckDB oracle SQL.

Every query reads the driver's test tables (or a dirty view over them, see
``sources.tables``) and runs the operator through this library's code. The
oracle SQL is written independently in plain SQL over the same tables.
Floating results are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.jsonfix import with_recovered_json
from sparkprep.operators import encode, features, heavy, impute, outliers, profile, quality, rows, schema, text
from sparkprep.plans.cleaner import PlanCleaner
from sparkprep.plans.runner import run_plan
from sparkprep.plans.spec import Action, Plan, deterministic_plan
from sparkprep.plans.suggest import suggest_plan
from sparkprep.sources import io
from sparkprep.sources.tables import dirty, duckdb_sql, table

#: The part types of the test tables, for the columns of a one-hot encoding in SQL.
PART_TYPES = ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD']

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def cte(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({duckdb_sql(n)})" for n in names) + "\n"


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


# ===================================================================== O23
ORDERS_COLS = [
    ("o_orderkey", True),
    ("o_custkey", True),
    ("price_txt", False),
    ("date_txt", False),
    ("o_orderpriority", False),
    ("o_orderstatus", False),
    ("o_totalprice", True),
]


def _profile_sql() -> str:
    parts = []
    for i, (c, num) in enumerate(ORDERS_COLS):
        order = f"TRY_CAST(v AS DOUBLE), v" if num else "v"
        samples = (
            f"(SELECT string_agg(v, '|' ORDER BY {order}) FROM (SELECT v FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v "
            f"FROM dirty_orders WHERE {c} IS NOT NULL) ORDER BY {order} LIMIT 5))"
        )
        if num:
            stats = [f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)", f"round(avg({c}), 6)", f"round(median({c}), 6)"]
        else:
            stats = ["CAST(NULL AS DOUBLE)"] * 4
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
            f"round((count(*) - count({c})) / count(*), 6) AS missing_ratio, count(DISTINCT {c}) AS n_unique, "
            f"coalesce({samples}, '') AS sample_values, {str(num).upper()} AS is_numeric, {str(not num).upper()} AS is_text_like, "
            f"count(DISTINCT {c}) <= 1 AS is_constant, {stats[0]} AS num_min, {stats[1]} AS num_max, "
            f"{stats[2]} AS num_mean, {stats[3]} AS num_median FROM dirty_orders"
        )
    return cte("dirty_orders") + "\nUNION ALL\n".join(parts)


@query("profile_dirty_orders", _profile_sql())
def q_profile(spark, sf):
    """O23 dataset profile of dirty orders (V1 + exact medians)."""
    p = profile.profile(dirty(spark, sf, "dirty_orders"))
    return p.select(
        "position", "column", "missing_count", "missing_ratio", "n_unique",
        F.array_join("sample_values", "|").alias("sample_values"),
        "is_numeric", "is_text_like", "is_constant", "num_min", "num_max", "num_mean", "num_median",
    )


@query(
    "target_profile_labelled_documents",
    cte("labelled_documents")
    + "SELECT coalesce(CAST(quality AS VARCHAR), 'None') AS class, count(*) AS count FROM labelled_documents GROUP BY 1",
)
def q_target_profile(spark, sf):
    """O23 target profile: class counts with missing as a class."""
    return profile.target_profile(dirty(spark, sf, "labelled_documents"), "quality")


# ====================================================================== O6
@query(
    "overview_documents",
    """
SELECT count(*) AS rows, 4 AS columns,
 CAST(sum((text IS NULL)::BIGINT + (lang IS NULL)::BIGINT + (source IS NULL)::BIGINT + (n_chars IS NULL)::BIGINT) AS BIGINT) AS total_missing,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS duplicate_rows,
 3 AS categorical_columns
FROM documents""",
)
def q_overview(spark, sf):
    """O6 overview (rows, columns, missing, duplicate rows) of the document
    table without its id column."""
    d = table(spark, sf, "documents").select("text", "lang", "source", "n_chars")
    return profile.overview(d)


@query(
    "overview_dirty_lineitem",
    cte("dirty_lineitem")
    + """
SELECT count(*) AS rows, 10 AS columns,
 CAST(sum((l_quantity IS NULL)::BIGINT + (l_extendedprice IS NULL)::BIGINT + (l_returnflag IS NULL)::BIGINT) AS BIGINT) AS total_missing,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty_lineitem)) AS duplicate_rows,
 2 AS categorical_columns
FROM dirty_lineitem""",
)
def q_overview_li(spark, sf):
    """O6 overview of dirty lineitem."""
    return profile.overview(dirty(spark, sf, "dirty_lineitem"))


# =========================================== columns of any type
_NESTED_DUCK = """WITH nested AS (SELECT embedding, [label, NULL, label % 3] AS codes,
 CASE WHEN vec_id % 5 = 0 THEN NULL ELSE {'a': label % 3, 'b': CASE WHEN vec_id % 2 = 0 THEN 'x' END} END AS pair,
 MAP {'l': label, 'm': 1} AS entries, CAST(9007199254740992 + label % 2 AS DECIMAL(20, 0)) AS big,
 CASE WHEN vec_id % 7 = 0 THEN NULL ELSE label / 4.0::DOUBLE END AS share FROM embeddings)
"""
_NESTED_COLS = ["embedding", "codes", "pair", "entries", "big", "share"]


def _nested(spark, sf):
    """Arrays with nulls, structs, maps (entries in either order), decimals
    beyond 2^53 and NaN, from the embeddings."""
    e = table(spark, sf, "embeddings")
    lab = F.col("label").cast("long")
    lm = [F.lit("l"), lab, F.lit("m"), F.lit(1).cast("long")]
    return e.select(
        "embedding",
        F.array(lab, F.lit(None).cast("long"), lab % 3).alias("codes"),
        F.when(F.col("vec_id") % 5 != 0, F.struct((lab % 3).alias("a"), F.when(F.col("vec_id") % 2 == 0, "x").alias("b"))).alias("pair"),
        F.when(F.col("vec_id") % 3 == 0, F.create_map(*lm)).otherwise(F.create_map(*lm[2:], *lm[:2])).alias("entries"),
        (F.lit(9007199254740992).cast("decimal(20,0)") + (lab % 2).cast("decimal(1,0)")).cast("decimal(20,0)").alias("big"),
        F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).otherwise(lab / F.lit(4.0)).alias("share"),
    )


@query(
    "column_types_nested_embeddings",
    _NESTED_DUCK
    + "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) - count({c}) AS missing, "
        f"round(100.0 * (count(*) - count({c})) / count(*), 1) AS missing_pct, count(DISTINCT {c}) AS n_unique FROM nested"
        for i, c in enumerate(_NESTED_COLS)
    ),
)
def q_types_nested(spark, sf):
    """O7 (and V1) over array, struct, map, decimal and NaN columns."""
    return profile.column_types(_nested(spark, sf)).drop("dtype")


@query(
    "overview_nested_embeddings",
    _NESTED_DUCK
    + """SELECT count(*) AS rows, 5 AS columns,
 CAST(sum((pair IS NULL)::BIGINT + (share IS NULL)::BIGINT) AS BIGINT) AS total_missing,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT codes, pair, entries, big, share FROM nested)) AS duplicate_rows,
 0 AS categorical_columns FROM nested""",
)
def q_overview_nested(spark, sf):
    """O6 with rows that differ, or agree, in nested columns only."""
    return profile.overview(_nested(spark, sf).drop("embedding"))


@query(
    "constant_nested_embeddings",
    _NESTED_DUCK
    + "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", n AS n_distinct, round(top, 6) AS top_ratio, n <= 1 AS is_constant, "
        f"n > 1 AND top >= 0.98 AS is_near_constant FROM (SELECT count(*) AS n, max(k) / sum(k) AS top FROM "
        f"(SELECT {c}, count(*) AS k FROM nested WHERE {c} IS NOT NULL GROUP BY {c}))"
        for i, c in enumerate(_NESTED_COLS)
    ),
)
def q_constant_nested(spark, sf):
    """P2 over columns of any type: two decimals beyond 2^53 are two values."""
    return quality.constant_columns(_nested(spark, sf), near_constant_threshold=0.98).withColumn("top_ratio", r6("top_ratio"))


# ====================================================================== O7
CUST_COLS = [("c_custkey", 0), ("Customer Name", 1), ("Nation-Key", 2), ("c_acctbal", 3), ("c_mktsegment", 4)]


@query(
    "column_types_dirty_customer",
    cte("dirty_customer")
    + "\nUNION ALL\n".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) - count({q(c)}) AS missing, "
        f"round(100.0 * (count(*) - count({q(c)})) / count(*), 1) AS missing_pct, count(DISTINCT {q(c)}) AS n_unique FROM dirty_customer"
        for c, i in CUST_COLS
    ),
)
def q_column_types(spark, sf):
    """O7 column type table (dtype omitted: engine-specific names)."""
    return profile.column_types(dirty(spark, sf, "dirty_customer")).drop("dtype")


# ====================================================================== O8
def _describe_sql():
    parts = []
    for i, (c, num) in enumerate(ORDERS_COLS):
        if num:
            parts.append(
                f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS count, CAST(NULL AS BIGINT) AS \"unique\", "
                f"CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
                f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
                f"quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM dirty_orders"
            )
        else:
            parts.append(
                f"SELECT {i}, '{c}', count({c}), count(DISTINCT {c}), "
                f"(SELECT v FROM (SELECT CAST({c} AS VARCHAR) v, count(*) n FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1), "
                f"(SELECT max(n) FROM (SELECT count(*) n FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c})), "
                "NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM dirty_orders"
            )
    return cte("dirty_orders") + "\nUNION ALL\n".join(parts)


@query("describe_dirty_orders", _describe_sql())
def q_describe(spark, sf):
    """O8 describe(include=all) in long form."""
    d = profile.describe(dirty(spark, sf, "dirty_orders"))
    return d.withColumn("mean", r6("mean")).withColumn("std", r6("std"))


# ====================================================================== O9
@query(
    "compare_customer_after_cleaning",
    cte("dirty_customer")
    + """, after AS (SELECT c_custkey, "Customer Name" AS customer_name, "Nation-Key" AS nation_key, c_acctbal, c_mktsegment
   FROM dirty_customer WHERE c_acctbal IS NOT NULL)
SELECT 'dataset' AS section, 'rows' AS name, (SELECT count(*) FROM dirty_customer) AS before, (SELECT count(*) FROM after) AS after
UNION ALL SELECT 'dataset', 'columns', 5, 5
UNION ALL SELECT 'dataset', 'missing', (SELECT count(*) - count(c_acctbal) + count(*) - count(c_mktsegment) FROM dirty_customer),
  (SELECT count(*) - count(c_mktsegment) FROM after)
UNION ALL SELECT 'dataset', 'duplicates', 0, 0
UNION ALL SELECT 'missing_by_column', 'c_acctbal', (SELECT count(*) - count(c_acctbal) FROM dirty_customer), 0
UNION ALL SELECT 'missing_by_column', 'c_mktsegment', (SELECT count(*) - count(c_mktsegment) FROM dirty_customer), (SELECT count(*) - count(c_mktsegment) FROM after)
UNION ALL SELECT 'schema', 'customer_name', 0, 1
UNION ALL SELECT 'schema', 'nation_key', 0, 1
UNION ALL SELECT 'schema', 'Customer Name', 1, 0
UNION ALL SELECT 'schema', 'Nation-Key', 1, 0""",
)
def q_compare(spark, sf):
    """O9 before/after comparison around drop-rows + fix-column-names."""
    before = dirty(spark, sf, "dirty_customer")
    after = schema.fix_column_names(rows.drop_missing_rows(before, ["c_acctbal"]).df).df
    return profile.compare(before, after)


# ================================================================ O10-O14
@query(
    "fix_column_names_customer",
    cte("dirty_customer")
    + 'SELECT c_custkey, "Customer Name" AS customer_name, "Nation-Key" AS nation_key, c_acctbal, c_mktsegment FROM dirty_customer',
)
def q_fix_names(spark, sf):
    """O10 column-name normalisation."""
    return schema.fix_column_names(dirty(spark, sf, "dirty_customer")).df


@query(
    "drop_column_lineitem",
    cte("dirty_lineitem")
    + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM dirty_lineitem",
)
def q_drop(spark, sf):
    """O11 drop columns (target protected)."""
    return schema.drop_column(dirty(spark, sf, "dirty_lineitem"), ["l_discount", "l_tax", "nope"], target_column="l_quantity", on_missing="skip").df


@query("cast_int_coerce_orders", cte("dirty_orders") + "SELECT o_orderkey, TRY_CAST(price_txt AS BIGINT) AS price_txt FROM dirty_orders")
def q_cast_int(spark, sf):
    """O12 cast text to int, coercing invalid values to null."""
    return schema.cast_type(dirty(spark, sf, "dirty_orders"), ["price_txt"], "int", "coerce").df.select("o_orderkey", "price_txt")


@query("cast_float_coerce_orders", cte("dirty_orders") + "SELECT o_orderkey, TRY_CAST(price_txt AS DOUBLE) AS price_txt FROM dirty_orders")
def q_cast_float(spark, sf):
    """O12 cast text to float, coercing invalid values to null."""
    return schema.cast_type(dirty(spark, sf, "dirty_orders"), ["price_txt"], "float", "coerce").df.select("o_orderkey", "price_txt")


@query(
    "cast_datetime_coerce_orders",
    cte("dirty_orders") + "SELECT o_orderkey, try_strptime(date_txt, '%Y-%m-%d') AS date_txt FROM dirty_orders",
)
def q_cast_dt(spark, sf):
    """O12 cast text to datetime with a strptime format, coercing failures."""
    return schema.cast_type(dirty(spark, sf, "dirty_orders"), ["date_txt"], "datetime", "coerce", "%Y-%m-%d").df.select(
        "o_orderkey", "date_txt"
    )


@query(
    "cast_int_nonintegral_coerce",
    "SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT) END AS o_totalprice FROM orders",
)
def q_cast_nonint(spark, sf):
    """O12 int cast of a double column: non-integral values coerced to null."""
    return schema.cast_type(table(spark, sf, "orders"), ["o_totalprice"], "int", "coerce").df.select("o_orderkey", "o_totalprice")


@query(
    "cast_string_bool_labels",
    "SELECT doc_id, CAST(quality AS BOOLEAN) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels",
)
def q_cast_bool(spark, sf):
    """O12 strict bool and string casts."""
    lab = table(spark, sf, "labels")
    out = schema.cast_type(lab, ["quality"], "bool").df
    return schema.cast_type(out, ["toxic"], "string").df


@query("schema_align_customer", "SELECT c_custkey, 0 AS extra_col, c_acctbal FROM customer")
def q_align(spark, sf):
    """O13 schema alignment: absent fitted columns -> 0, extras dropped."""
    return schema.align_schema(table(spark, sf, "customer"), ["c_custkey", "extra_col", "c_acctbal"])


@query(
    "drop_missing_rows_lineitem",
    cte("dirty_lineitem") + "SELECT * FROM dirty_lineitem WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL",
)
def q_drop_rows(spark, sf):
    """O14 handle_missing(strategy=drop_rows)."""
    return impute.handle_missing(dirty(spark, sf, "dirty_lineitem"), ["l_quantity", "l_returnflag"], "drop_rows").df


# ===================================================================== O17


def _ddb_strip(x):
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _ddb_collapse(x):
    return _ddb_strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


@query("normalize_text_documents", f"SELECT doc_id, {_ddb_collapse('lower(' + _ddb_strip('text') + ')')} AS text FROM documents")
def q_norm_docs(spark, sf):
    """O17 normalize_text with the default ops (strip, lower, collapse)."""
    return text.normalize_text(table(spark, sf, "documents"), ["text"]).df.select("doc_id", "text")


@query(
    "normalize_text_accents_documents",
    f"SELECT doc_id, {_ddb_collapse('strip_accents(lower(' + _ddb_strip('text') + '))')} AS text FROM documents",
)
def q_norm_accents(spark, sf):
    """O17 normalize_text with remove_accents (NFKD, marks dropped)."""
    return text.normalize_text(
        table(spark, sf, "documents"), ["text"], ops=["strip", "lower", "remove_accents", "collapse_whitespace"]
    ).df.select("doc_id", "text")


_SEG = "regexp_replace(regexp_replace(" + "lower(" + _ddb_strip("c_mktsegment") + "), 'build', 'BLD', 'g'), '(mach)inery', '\\1', 'g')"


@query(
    "normalize_text_rules_customer",
    cte("dirty_customer")
    + f"SELECT c_custkey, CASE WHEN lower({_SEG}) IN ('n/a', 'none') THEN NULL ELSE {_SEG} END AS c_mktsegment FROM dirty_customer",
)
def q_norm_rules(spark, sf):
    """O17 regex rules in order and null-like values to null."""
    return text.normalize_text(
        dirty(spark, sf, "dirty_customer"), ["c_mktsegment"], ops=["strip", "lower"],
        replace=[{"pattern": "build", "repl": "BLD"}, {"pattern": "(mach)inery", "repl": r"\1"}],
        null_like_to_nan=["N/A", "none"],
    ).df.select("c_custkey", "c_mktsegment")


@query(
    "normalize_text_audit_customer",
    cte("dirty_customer")
    + f"""SELECT 'c_mktsegment' AS "column",
 CAST(count_if(c_mktsegment IS NOT NULL AND lower({_SEG}) NOT IN ('n/a', 'none') AND c_mktsegment <> {_SEG}) AS BIGINT) AS values_changed,
 CAST(count_if(c_mktsegment IS NOT NULL AND lower({_SEG}) IN ('n/a', 'none')) AS BIGINT) AS null_like_converted,
 CAST(sum(CASE WHEN c_mktsegment IS NULL THEN 0 ELSE
   (CASE WHEN lower({_ddb_strip('c_mktsegment')}) <> regexp_replace(lower({_ddb_strip('c_mktsegment')}), 'build', 'BLD', 'g') THEN 1 ELSE 0 END)
 + (CASE WHEN regexp_replace(lower({_ddb_strip('c_mktsegment')}), 'build', 'BLD', 'g') <> {_SEG} THEN 1 ELSE 0 END) END) AS BIGINT) AS replacements_applied
FROM dirty_customer""",
)
def q_norm_audit(spark, sf):
    """O17g change audit of normalize_text (values changed, null-like, rules)."""
    return text.changes_by_column(
        dirty(spark, sf, "dirty_customer"), ["c_mktsegment"], ops=["strip", "lower"],
        replace=[{"pattern": "build", "repl": "BLD"}, {"pattern": "(mach)inery", "repl": r"\1"}],
        null_like_to_nan=["N/A", "none"],
    )


# ================================================================ O19-O21
@query(
    "dedup_documents_text_first",
    "SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) rn FROM documents) WHERE rn = 1",
)
def q_dedup_first(spark, sf):
    """O19 deduplicate on text, keep first by doc_id."""
    return rows.deduplicate(table(spark, sf, "documents"), ["text"], "first", order_by=["doc_id"]).df


@query(
    "dedup_documents_text_last",
    "SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) rn FROM documents) WHERE rn = 1",
)
def q_dedup_last(spark, sf):
    """O19 deduplicate on text, keep last by doc_id."""
    return rows.deduplicate(table(spark, sf, "documents"), ["text"], "last", order_by=["doc_id"]).df


@query(
    "dedup_documents_text_none",
    "SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, count(*) OVER (PARTITION BY text) n FROM documents) WHERE n = 1",
)
def q_dedup_none(spark, sf):
    """O20 deduplicate keep=none: every member of a duplicated group dropped."""
    return rows.deduplicate(table(spark, sf, "documents"), ["text"], "none").df


@query(
    "dedup_customer_case_insensitive",
    cte("dirty_customer")
    + 'SELECT c_custkey, "Customer Name", "Nation-Key", c_acctbal, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) rn FROM dirty_customer) WHERE rn = 1',
)
def q_dedup_ci(spark, sf):
    """O19 case-insensitive subset dedup (missing equals missing)."""
    return rows.deduplicate(dirty(spark, sf, "dirty_customer"), ["c_mktsegment"], "first", True, ["c_custkey"]).df


@query("dedup_full_rows_documents", "SELECT DISTINCT text, lang, source FROM documents")
def q_dedup_full(spark, sf):
    """O19 full-row deduplication."""
    return rows.deduplicate(table(spark, sf, "documents").select("text", "lang", "source")).df


@query(
    "dedup_lineitem_keys_first",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER
 (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) rn FROM lineitem) WHERE rn = 1""",
)
def q_dedup_li(spark, sf):
    """O19 dedup on a non-unique composite key, keep first by (partkey, suppkey)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rows.deduplicate(li, ["l_orderkey", "l_linenumber"], "first", order_by=["l_partkey", "l_suppkey"]).df


@query(
    "duplicate_key_examples_lineitem",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
 ORDER BY 1, 2 LIMIT 3""",
)
def q_dup_examples(spark, sf):
    """O21 the three smallest duplicated keys (a top-k report)."""
    return rows.duplicate_key_examples(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ================================================================ O22/O30
@query(
    "outliers_iqr_drop_events",
    """WITH b AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events)
SELECT event_id, value FROM events, b WHERE NOT (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))""",
)
def q_out_iqr(spark, sf):
    """O22/O30 IQR outlier row drop (k=1.5)."""
    return outliers.remove_outliers(table(spark, sf, "events"), ["value"], "iqr", 1.5).df.select("event_id", "value")


@query(
    "outliers_zscore_clip_events",
    """WITH b AS (SELECT avg(value) - 3.0 * stddev_pop(value) lo, avg(value) + 3.0 * stddev_pop(value) hi FROM events)
SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM events, b""",
)
def q_out_z(spark, sf):
    """O30 z-score clipping (3 sigma, population std)."""
    out = outliers.remove_outliers(table(spark, sf, "events"), ["value"], "zscore", mode="clip").df
    return out.select("event_id", r6("value").alias("value"))


@query(
    "outliers_iqr_all_lineitem",
    cte("dirty_lineitem")
    + """, b AS (SELECT quantile_cont(l_quantity, 0.25) a1, quantile_cont(l_quantity, 0.75) a3,
  quantile_cont(l_extendedprice, 0.25) b1, quantile_cont(l_extendedprice, 0.75) b3 FROM dirty_lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM dirty_lineitem, b
WHERE NOT (coalesce(l_quantity < a1 - 0.5 * (a3 - a1) OR l_quantity > a3 + 0.5 * (a3 - a1), false)
       AND coalesce(l_extendedprice < b1 - 0.5 * (b3 - b1) OR l_extendedprice > b3 + 0.5 * (b3 - b1), false))""",
)
def q_out_all(spark, sf):
    """O22 two-column outlier drop with combine=all (k=0.5), missing never flagged."""
    out = outliers.remove_outliers(dirty(spark, sf, "dirty_lineitem"), ["l_quantity", "l_extendedprice"], "iqr", 0.5, combine="all").df
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query(
    "clip_outliers_stage_documents",
    """WITH b AS (SELECT quantile_cont(n_chars, 0.25) q1, quantile_cont(n_chars, 0.75) q3 FROM documents)
SELECT doc_id, round(CASE WHEN n_chars < q1 - 3.0 * (q3 - q1) THEN q1 - 3.0 * (q3 - q1)
 WHEN n_chars > q3 + 3.0 * (q3 - q1) THEN q3 + 3.0 * (q3 - q1) ELSE n_chars END, 6) AS n_chars FROM documents, b""",
)
def q_clip_stage(spark, sf):
    """O30 stage form: clip_outliers with k=3.0 fitted and replayed."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    model = PlanCleaner(Plan(actions=[Action("clip_outliers", params={"columns": ["n_chars"]})])).fit(d)
    return model.transform(d).select("doc_id", r6("n_chars").alias("n_chars"))


# ================================================================ V1, O24-O29
@query(
    "value_counts_orders",
    cte("dirty_orders")
    + """SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS cnt FROM dirty_orders WHERE o_orderpriority IS NOT NULL GROUP BY 2
UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM dirty_orders GROUP BY 2""",
)
def q_vc(spark, sf):
    """V1 long value counts of several columns in one shuffle."""
    return profile.value_counts_long(dirty(spark, sf, "dirty_orders"), ["o_orderpriority", "o_orderstatus"]).drop("num")


@query(
    "numeric_summary_lineitem",
    cte("dirty_lineitem")
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, "
        f"round(stddev_pop({c}), 9) AS std_pop, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM dirty_lineitem"
        for c in ["l_quantity", "l_extendedprice", "l_discount"]
    ),
)
def q_numsum(spark, sf):
    """O24/O25 count, mean, sample and population std, min, max."""
    s = profile.numeric_summary_long(dirty(spark, sf, "dirty_lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    # 9 dp: means of 2-decimal data have at most 8 decimals, so 6 dp would
    # sit exactly on rounding ties where summation order decides the digit.
    r9 = lambda c: F.round(c, 9)
    return s.select("column", "count", r9("mean").alias("mean"), r9("std").alias("std"), r9("std_pop").alias("std_pop"), "min", "max")


_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def _quant_sql():
    parts = []
    for c in ["l_quantity", "l_extendedprice", "l_discount"]:
        for i, p in enumerate(_PROBS):
            parts.append(f"SELECT '{c}' AS \"column\", {i} AS p_index, {p}::DOUBLE AS prob, round(quantile_cont({c}, {p}), 6) AS value FROM dirty_lineitem")
    return cte("dirty_lineitem") + "\nUNION ALL\n".join(parts)


@query("quantiles_lineitem", _quant_sql())
def q_quant(spark, sf):
    """O26 exact linear quantiles by selection over the raw rows."""
    ql = profile.quantiles_long(dirty(spark, sf, "dirty_lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], _PROBS)
    return ql.withColumn("value", r6("value"))


@query("quantiles_bucketed_lineitem", _quant_sql())
def q_quant_b(spark, sf):
    """O26 exact quantiles by weighted selection over distinct values (the
    way taken when a value-count table exists)."""
    d = dirty(spark, sf, "dirty_lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    dv = profile.value_counts_long(d, cols).select("column", "num", "cnt")
    ql = profile.quantiles_from_counts(dv, _PROBS, hold=64)
    return ql.withColumn("value", r6("value"))


@query("quantiles_bracket_lineitem", _quant_sql())
def q_quant_sel(spark, sf):
    """O26 exact quantiles by selection in several rounds: the last aggregate
    may hold 64 rows in all."""
    ql = profile.quantiles_long(
        dirty(spark, sf, "dirty_lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], _PROBS, hold=64
    )
    return ql.withColumn("value", r6("value"))


@query(
    "mode_orders",
    cte("dirty_orders")
    + """SELECT "column", value AS mode, n AS mode_count FROM (
 SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) rn FROM (
  SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) n FROM dirty_orders WHERE o_orderpriority IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM dirty_orders GROUP BY 2
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM dirty_orders GROUP BY 2)) WHERE rn = 1""",
)
def q_mode(spark, sf):
    """O27 mode with ties broken by the smallest string."""
    vc = profile.value_counts_long(dirty(spark, sf, "dirty_orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])
    return profile.modes(vc)


_TOP_COLUMNS = ["l_returnflag", "l_partkey", "l_quantity", "l_orderkey", "l_linenumber"]


@query(
    "top_values_lineitem",
    """SELECT "column", value, n AS cnt, rn::INTEGER AS rank FROM (
 SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) rn FROM ("""
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 2"""
        for c in _TOP_COLUMNS
    )
    + ")) WHERE rn <= 3",
)
def q_top_values(spark, sf):
    """O27 and the heavy hitters of P2: the three most frequent values of a
    column, from merged summaries where these are sure, else from all counts."""
    top = heavy.top_counts(table(spark, sf, "lineitem"), _TOP_COLUMNS, 3)
    return top.select("column", "value", "cnt", "rank")


@query(
    "skewness_events",
    """SELECT 'value' AS "column", round(skewness(value), 6) AS skew FROM events
UNION ALL SELECT 'user_id', round(skewness(user_id), 6) FROM events
UNION ALL SELECT 'n_chars', round((SELECT skewness(n_chars) FROM documents), 6)""",
)
def q_skew(spark, sf):
    """O28 adjusted Fisher-Pearson skewness G1."""
    from sparkprep.functions.stats import adjusted_skew

    ev = table(spark, sf, "events")
    docs = table(spark, sf, "documents")
    a = ev.agg(F.lit("value").alias("column"), F.round(adjusted_skew(F.col("value")), 6).alias("skew"))
    b = ev.agg(F.lit("user_id").alias("column"), F.round(adjusted_skew(F.col("user_id").cast("double")), 6).alias("skew"))
    c = docs.agg(F.lit("n_chars").alias("column"), F.round(adjusted_skew(F.col("n_chars").cast("double")), 6).alias("skew"))
    return a.unionByName(b).unionByName(c)


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "corr_matrix_lineitem",
    cte("dirty_lineitem")
    + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM dirty_lineitem"
        for i, a in enumerate(_CORR_COLS)
        for b in _CORR_COLS[i + 1 :]
    ),
)
def q_corr(spark, sf):
    """O29 pairwise-complete Pearson matrix (upper triangle)."""
    return profile.corr_long(dirty(spark, sf, "dirty_lineitem"), _CORR_COLS).withColumn("corr", r6("corr"))


_PARTNERLESS = {
    "x": "CASE WHEN l_linenumber = 7 THEN -1000000000 ELSE CAST(l_quantity AS DOUBLE) END",
    "y": "CASE WHEN l_linenumber <> 7 THEN CAST(l_extendedprice AS DOUBLE) END",
    "z": "CAST(l_discount AS DOUBLE)",
}


@query(
    "corr_partnerless_outlier_lineitem",
    "WITH t AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PARTNERLESS.items()) + " FROM lineitem)\n"
    + "\nUNION ALL\n".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM t" for a, b in ("xy", "xz", "yz")),
)
def q_corr_partnerless(spark, sf):
    """O29 where a column's outliers have no partner, and another column stands far from zero."""
    t = table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in _PARTNERLESS.items()]).withColumn("z", F.col("z") + 1e6)
    return profile.corr_long(t, list(_PARTNERLESS)).withColumn("corr", r6("corr"))


# ================================================================ O31-O33
_MODE_RF = "(SELECT v FROM (SELECT l_returnflag v, count(*) n FROM dirty_lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)"


@query(
    "impute_mode_lineitem",
    cte("dirty_lineitem") + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(l_returnflag, {_MODE_RF}) AS l_returnflag FROM dirty_lineitem",
)
def q_imp_mode(spark, sf):
    """O31 categorical most-frequent imputation."""
    out = impute.handle_missing(dirty(spark, sf, "dirty_lineitem"), ["l_returnflag"]).df
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


@query(
    "impute_constant_customer",
    cte("dirty_customer") + "SELECT c_custkey, coalesce(c_mktsegment, 'MISSING') AS c_mktsegment FROM dirty_customer",
)
def q_imp_const(spark, sf):
    """O31 categorical constant imputation."""
    out = impute.handle_missing(dirty(spark, sf, "dirty_customer"), ["c_mktsegment"], impute={"categorical": "constant"}).df
    return out.select("c_custkey", "c_mktsegment")


@query(
    "impute_median_lineitem",
    cte("dirty_lineitem")
    + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 round(coalesce(l_quantity, (SELECT median(l_quantity) FROM dirty_lineitem)), 6) AS l_quantity,
 round(coalesce(l_extendedprice, (SELECT median(l_extendedprice) FROM dirty_lineitem)), 6) AS l_extendedprice FROM dirty_lineitem""",
)
def q_imp_median(spark, sf):
    """O32 numeric median imputation."""
    out = impute.handle_missing(dirty(spark, sf, "dirty_lineitem"), ["l_quantity", "l_extendedprice"], impute={"numeric": "median"}).df
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("l_quantity").alias("l_quantity"), r6("l_extendedprice").alias("l_extendedprice"))


@query(
    "impute_mice_single_customer",
    cte("dirty_customer") + "SELECT c_custkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM dirty_customer)), 6) AS c_acctbal FROM dirty_customer",
)
def q_imp_mice1(spark, sf):
    """O33 chained-regression imputation with one participating column (= mean)."""
    out = impute.handle_missing(dirty(spark, sf, "dirty_customer"), ["c_acctbal"]).df
    return out.select("c_custkey", r6("c_acctbal").alias("c_acctbal"))


def _mice_pair_sql():
    """Chained Bayesian-ridge regressions of two columns as one recursion over
    the sums of the three missing patterns that have an observed value (``b``
    both, ``q`` only the quantity, ``p`` only the price). A row of the
    recursion is a set-up (``it`` -1), an evidence iteration or a finished
    regression (``done``). Fills: q = aq + bq p, p = ap + bp q, and (uq, up)
    where both are missing."""
    # the feature of turn 0 is the one with fewer missing values
    t = {
        "y": lambda col: f"CASE WHEN on_q THEN q_{col} ELSE p_{col} END",
        "fa": "CASE WHEN on_q THEN ap ELSE aq END",
        "fb": "CASE WHEN on_q THEN bp ELSE bq END",
    }
    return (
        cte("dirty_lineitem").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
        + f""",
x AS (SELECT l_quantity AS q, l_extendedprice AS p FROM dirty_lineitem),
sums AS (SELECT
  avg(q) AS mq, avg(p) AS mp, count(*) - count(q) <= count(*) - count(p) AS q_first,
  0.001 * greatest(max(abs(q)), max(abs(p))) AS tol,
  count(*) FILTER (q IS NOT NULL AND p IS NOT NULL) AS b_n,
  avg(q) FILTER (p IS NOT NULL) AS b_q, avg(p) FILTER (q IS NOT NULL) AS b_p,
  regr_syy(q, p) AS b_qq, regr_sxx(q, p) AS b_pp, regr_sxy(q, p) AS b_qp,
  count(q) FILTER (p IS NULL) AS q_n, coalesce(avg(q) FILTER (p IS NULL), 0) AS q_m,
  coalesce(var_pop(q) FILTER (p IS NULL), 0) * q_n AS q_s, coalesce(min(q) FILTER (p IS NULL), 0) AS q_lo, coalesce(max(q) FILTER (p IS NULL), 0) AS q_hi,
  count(p) FILTER (q IS NULL) AS p_n, coalesce(avg(p) FILTER (q IS NULL), 0) AS p_m,
  coalesce(var_pop(p) FILTER (q IS NULL), 0) * p_n AS p_s, coalesce(min(p) FILTER (q IS NULL), 0) AS p_lo, coalesce(max(p) FILTER (q IS NULL), 0) AS p_hi
 FROM x),
fit AS (
 SELECT 1 AS rnd, 0 AS turn, -1 AS it, FALSE AS done, FALSE AS stop,
  0::DOUBLE AS n, 0::DOUBLE AS my, 0::DOUBLE AS mx, 0::DOUBLE AS sxx, 0::DOUBLE AS sxy, 0::DOUBLE AS syy,
  0::DOUBLE AS alpha, 0::DOUBLE AS lam, 0::DOUBLE AS coef,
  mq AS aq, 0::DOUBLE AS bq, mp AS ap, 0::DOUBLE AS bp, mq AS uq, mp AS up,
  mq AS aq0, 0::DOUBLE AS bq0, mp AS ap0, 0::DOUBLE AS bp0, mq AS uq0, mp AS up0 FROM sums
 UNION ALL
 SELECT rnd1, turn1, it1, done1, stop1, n1, my1, mx1, sxx1, sxy1, syy1, alpha1, lam1, coef1, aq1, bq1, ap1, bp1, uq1, up1,
  CASE WHEN rnd1 > rnd THEN aq1 ELSE aq0 END, CASE WHEN rnd1 > rnd THEN bq1 ELSE bq0 END,
  CASE WHEN rnd1 > rnd THEN ap1 ELSE ap0 END, CASE WHEN rnd1 > rnd THEN bp1 ELSE bp0 END,
  CASE WHEN rnd1 > rnd THEN uq1 ELSE uq0 END, CASE WHEN rnd1 > rnd THEN up1 ELSE up0 END
 FROM (
  SELECT *,
   -- one evidence iteration, or the closing solution
   sxy / (sxx + lam / alpha) AS c,
   greatest(syy - 2 * c * sxy + c * sxx * c, 0) AS rmse,
   alpha * sxx / (lam + alpha * sxx) AS gamma,
   (gamma + 2e-6) / (c * c + 2e-6) AS lam_next,
   (n - gamma + 2e-6) / (rmse + 2e-6) AS alpha_next,
   it >= 0 AND NOT done AS iterates, it >= 0 AND done AS closes,
   CASE WHEN iterates THEN it = 299 OR (it > 0 AND abs(coef - c) < 1e-3) ELSE FALSE END AS done1,
   CASE WHEN it = -1 THEN n_s ELSE n END AS n1, CASE WHEN it = -1 THEN my_s ELSE my END AS my1, CASE WHEN it = -1 THEN mx_s ELSE mx END AS mx1,
   CASE WHEN it = -1 THEN sxx_s ELSE sxx END AS sxx1, CASE WHEN it = -1 THEN sxy_s ELSE sxy END AS sxy1, CASE WHEN it = -1 THEN syy_s ELSE syy END AS syy1,
   CASE WHEN it = -1 THEN 1 / (syy_s / n_s + 2.220446049250313e-16) WHEN iterates THEN alpha_next ELSE alpha END AS alpha1,
   CASE WHEN it = -1 THEN 1 WHEN iterates THEN lam_next ELSE lam END AS lam1,
   CASE WHEN iterates THEN c ELSE coef END AS coef1,
   my - mx * c AS cut,
   CASE WHEN closes AND on_q THEN cut ELSE aq END AS aq1, CASE WHEN closes AND on_q THEN c ELSE bq END AS bq1,
   CASE WHEN closes AND NOT on_q THEN cut ELSE ap END AS ap1, CASE WHEN closes AND NOT on_q THEN c ELSE bp END AS bp1,
   CASE WHEN closes AND on_q THEN cut + c * up ELSE uq END AS uq1, CASE WHEN closes AND NOT on_q THEN cut + c * uq ELSE up END AS up1,
   -- the change of a row is convex in its observed value, so largest at an end
   greatest(abs(aq1 - aq0 + (bq1 - bq0) * p_lo), abs(aq1 - aq0 + (bq1 - bq0) * p_hi),
            abs(ap1 - ap0 + (bp1 - bp0) * q_lo), abs(ap1 - ap0 + (bp1 - bp0) * q_hi), abs(uq1 - uq0) + abs(up1 - up0)) AS change,
   closes AND turn = 1 AS ends,
   ends AND (rnd = 10 OR change < tol) AS stop1,
   CASE WHEN ends AND NOT stop1 THEN rnd + 1 ELSE rnd END AS rnd1,
   CASE WHEN closes THEN 1 - turn ELSE turn END AS turn1,
   CASE WHEN closes THEN -1 ELSE it + 1 END AS it1
  FROM (
   SELECT *, fa + fb * o_m AS f_m, b_n + o_n AS n_s,
    (b_n * b_y + o_n * o_m) / n_s AS my_s, (b_n * b_x + o_n * f_m) / n_s AS mx_s,
    b_xx + b_n * (b_x - mx_s) ** 2 + fb * fb * o_s + o_n * (f_m - mx_s) ** 2 AS sxx_s,
    b_qp + b_n * (b_x - mx_s) * (b_y - my_s) + fb * o_s + o_n * (f_m - mx_s) * (o_m - my_s) AS sxy_s,
    b_yy + b_n * (b_y - my_s) ** 2 + o_s + o_n * (o_m - my_s) ** 2 AS syy_s
   FROM (
    SELECT *, (turn = 0) = q_first AS on_q,
     {t['y']('n')} AS o_n, {t['y']('m')} AS o_m, {t['y']('s')} AS o_s, {t['fa']} AS fa, {t['fb']} AS fb,
     CASE WHEN on_q THEN b_q ELSE b_p END AS b_y, CASE WHEN on_q THEN b_p ELSE b_q END AS b_x,
     CASE WHEN on_q THEN b_qq ELSE b_pp END AS b_yy, CASE WHEN on_q THEN b_pp ELSE b_qq END AS b_xx
    FROM fit, sums WHERE NOT stop))))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 round(coalesce(l_quantity, CASE WHEN l_extendedprice IS NULL THEN uq ELSE aq + bq * l_extendedprice END), 6) AS l_quantity,
 round(coalesce(l_extendedprice, CASE WHEN l_quantity IS NULL THEN up ELSE ap + bp * l_quantity END), 6) AS l_extendedprice
FROM dirty_lineitem, (SELECT * FROM fit WHERE stop)"""
    )


@query("impute_mice_multi_lineitem", _mice_pair_sql())
def q_imp_mice(spark, sf):
    """O33 chained-regression (MICE) imputation over two numeric columns; the
    oracle solves it over the sums of the missing patterns."""
    out = impute.handle_missing(dirty(spark, sf, "dirty_lineitem"), ["l_quantity", "l_extendedprice"]).df
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("l_quantity").alias("l_quantity"), r6("l_extendedprice").alias("l_extendedprice"))


# ================================================================ O34-O38
_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "one_hot_orderpriority",
    cte("dirty_orders")
    + "SELECT o_orderkey, "
    + ", ".join(
        f"CASE WHEN o_orderpriority IS NULL THEN NULL ELSE (o_orderpriority = '{p}')::BIGINT END AS {q('o_orderpriority__' + p)}" for p in _PRIO
    )
    + " FROM dirty_orders",
)
def q_onehot(spark, sf):
    """O34 eager one-hot (null input -> null indicators)."""
    out = encode.one_hot(dirty(spark, sf, "dirty_orders"), ["o_orderpriority"]).df
    return out.select("o_orderkey", *[c for c in out.columns if c.startswith("o_orderpriority__")])


def _brand_topk_sql(k=10):
    brands = "(SELECT p_brand FROM (SELECT p_brand, count(*) n FROM part GROUP BY 1) ORDER BY n DESC, p_brand LIMIT %d)" % k
    return f"WITH kept AS {brands}, m AS (SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM kept) THEN p_brand ELSE 'OTHER' END AS b FROM part) SELECT p_partkey, b AS brand, 1::BIGINT AS flag FROM m"


@query("one_hot_topk_brand", _brand_topk_sql())
def q_onehot_topk(spark, sf):
    """O34 one-hot with top-K + OTHER (K=10 of 25 brands), shown in long
    form (one row per part with its set indicator)."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    out = encode.one_hot(p, ["p_brand"], max_categories=10).df
    ind = [c for c in out.columns if c.startswith("p_brand__")]
    stacked = F.explode(F.array(*[F.struct(F.lit(c[len("p_brand__"):]).alias("brand"), F.col(f"`{c}`").alias("flag")) for c in ind]))
    return out.select("p_partkey", stacked.alias("s")).select("p_partkey", "s.brand", "s.flag").filter(F.col("flag") == 1)


@query("ordinal_alpha_type", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::BIGINT AS p_type__ord FROM part")
def q_ord_alpha(spark, sf):
    """O35 ordinal codes, alphabetical order."""
    return encode.ordinal(table(spark, sf, "part").select("p_partkey", "p_type"), ["p_type"]).df


@query(
    "ordinal_frequency_brand",
    """WITH c AS (SELECT p_brand, (row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1)::BIGINT AS code FROM part GROUP BY p_brand)
SELECT p_partkey, code AS p_brand__ord FROM part JOIN c USING (p_brand)""",
)
def q_ord_freq(spark, sf):
    """O35 ordinal codes by frequency (count desc, value asc)."""
    return encode.ordinal(table(spark, sf, "part").select("p_partkey", "p_brand"), ["p_brand"], "frequency").df


@query(
    "one_hot_stage_orderpriority",
    cte("dirty_orders")
    + "SELECT o_orderkey, "
    + ", ".join(f"(coalesce(o_orderpriority, 'nan') = '{p}')::DOUBLE AS {q('o_orderpriority_' + p)}" for p in _PRIO + ["nan"])
    + " FROM dirty_orders",
)
def q_onehot_stage(spark, sf):
    """O36 stage one-hot: missing is a category, float indicators."""
    d = dirty(spark, sf, "dirty_orders").select("o_orderkey", "o_orderpriority")
    m = PlanCleaner(Plan(actions=[Action("encode_categorical", params={"method": "one_hot", "columns": ["o_orderpriority"]})])).fit(d)
    return m.transform(d)


@query(
    "ordinal_stage_customer",
    cte("dirty_customer")
    + """SELECT c_custkey, (dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1)::DOUBLE AS c_mktsegment__ord,
 (dense_rank() OVER (ORDER BY "Customer Name") - 1)::DOUBLE AS "Customer Name__ord" FROM dirty_customer""",
)
def q_ord_stage(spark, sf):
    """O37 stage ordinal (float codes, missing as category); the 1 500-value
    name column uses the joined code table instead of a literal map."""
    d = dirty(spark, sf, "dirty_customer").select("c_custkey", "c_mktsegment", "Customer Name")
    m = PlanCleaner(Plan(actions=[Action("encode_categorical", params={"method": "ordinal"})])).fit(d)
    return m.transform(d)


@query(
    "encode_per_column_part",
    """WITH b AS (SELECT p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS p_brand__ord FROM (SELECT DISTINCT p_brand FROM part))
SELECT part.p_partkey, part.p_size, b.p_brand__ord, """
    + ", ".join(f"(p_type = '{t}')::INTEGER::DOUBLE AS \"p_type_{t}\"" for t in PART_TYPES)
    + " FROM part JOIN b USING (p_brand)",
)
def q_enc_pc(spark, sf):
    """O38 per-column encoding: brand ordinal (key matched after name
    normalisation), type one-hot with data-driven width."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    m = PlanCleaner(
        Plan(actions=[Action("encode_categorical_per_column", params={"column_encodings": {"P_Brand": "ordinal"}, "default_method": "one_hot"})])
    ).fit(p)
    return m.transform(p)


# ===================================================================== O39
def _select_sql():
    return """, v AS (SELECT var_samp(o_orderkey) v1, var_samp(o_totalprice) v2, var_samp(leak_linear) v3, var_samp(const_col) v4 FROM leaky)
SELECT 'const_col' AS "column", 'low_variance' AS reason FROM v WHERE v4 < 0.01
UNION ALL SELECT 'o_orderkey', 'low_variance' FROM v WHERE v1 < 0.01
UNION ALL SELECT 'leak_linear', 'correlated' FROM leaky HAVING abs(corr(o_totalprice, leak_linear)) > 0.95 OR abs(corr(o_orderkey, leak_linear)) > 0.95
UNION ALL SELECT 'o_totalprice', 'correlated' FROM leaky HAVING abs(corr(o_orderkey, o_totalprice)) > 0.95"""


@query("select_features_leaky_orders", cte("leaky_orders").replace("leaky_orders AS", "leaky AS") + _select_sql())
def q_select(spark, sf):
    """O39 variance + correlation feature selection (report of drops)."""
    st = features.fit_select_features(dirty(spark, sf, "leaky_orders"))
    rows_ = [(c, "low_variance") for c in st["low_variance"]] + [(c, "correlated") for c in st["correlated"]]
    return spark.createDataFrame(rows_, "column string, reason string")


@query(
    "select_features_lineitem",
    """WITH v AS (SELECT var_samp(l_quantity) a, var_samp(l_extendedprice) b, var_samp(l_discount) c, var_samp(l_tax) d FROM lineitem)
SELECT 'l_discount' AS "column", 'low_variance' AS reason FROM v WHERE c < 0.01
UNION ALL SELECT 'l_tax', 'low_variance' FROM v WHERE d < 0.01
UNION ALL SELECT 'l_quantity', 'low_variance' FROM v WHERE a < 0.01
UNION ALL SELECT 'l_extendedprice', 'low_variance' FROM v WHERE b < 0.01""",
)
def q_select_li(spark, sf):
    """O39 on lineitem's measures (discount and tax fall below 0.01)."""
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    st = features.fit_select_features(li)
    rows_ = [(c, "low_variance") for c in st["low_variance"]] + [(c, "correlated") for c in st["correlated"]]
    return spark.createDataFrame(rows_, "column string, reason string")


# ===================================================================== O40
def _bin_quantile_sql(col, tbl, key, n):
    qs = ", ".join(f"quantile_cont({col}, {i / n}) e{i}" for i in range(n + 1))
    # keep an interior edge only when it is more than 1e-8 above the last kept one
    kept = []
    for i in range(1, n):
        kept.append(f"CASE WHEN e{i} - e{i - 1} > 1e-8 AND {col} >= e{i} THEN 1 ELSE 0 END")
    return f"WITH e AS (SELECT {qs} FROM {tbl}) SELECT {key}, ({' + '.join(kept)})::DOUBLE AS {col}__bin FROM {tbl}, e"


@query("bin_quantile_part", _bin_quantile_sql("p_retailprice", "part", "p_partkey", 5))
def q_bin_q(spark, sf):
    """O40 quantile bins (5), ordinal codes."""
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    st = features.fit_bin_numeric(p, ["p_retailprice"], 5, "quantile")
    return features.apply_bin_numeric(p, st)


@query(
    "bin_uniform_orders",
    """WITH m AS (SELECT min(o_totalprice) mn, max(o_totalprice) mx FROM orders)
SELECT o_orderkey, ((CASE WHEN o_totalprice >= 1 * ((mx - mn) / 5) + mn THEN 1 ELSE 0 END)
 + (CASE WHEN o_totalprice >= 2 * ((mx - mn) / 5) + mn THEN 1 ELSE 0 END)
 + (CASE WHEN o_totalprice >= 3 * ((mx - mn) / 5) + mn THEN 1 ELSE 0 END)
 + (CASE WHEN o_totalprice >= 4 * ((mx - mn) / 5) + mn THEN 1 ELSE 0 END))::DOUBLE AS o_totalprice__bin FROM orders, m""",
)
def q_bin_u(spark, sf):
    """O40 uniform bins (5)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    st = features.fit_bin_numeric(o, ["o_totalprice"], 5, "uniform")
    return features.apply_bin_numeric(o, st)


@query(
    "bin_onehot_part",
    """WITH e AS (SELECT quantile_cont(p_retailprice, 0.25) e1, quantile_cont(p_retailprice, 0.5) e2, quantile_cont(p_retailprice, 0.75) e3 FROM part),
c AS (SELECT p_partkey, (p_retailprice >= e1)::INT + (p_retailprice >= e2)::INT + (p_retailprice >= e3)::INT AS k FROM part, e)
SELECT p_partkey, (k = 0)::DOUBLE AS p_retailprice__bin_0, (k = 1)::DOUBLE AS p_retailprice__bin_1,
 (k = 2)::DOUBLE AS p_retailprice__bin_2, (k = 3)::DOUBLE AS p_retailprice__bin_3 FROM c""",
)
def q_bin_oh(spark, sf):
    """O40 quantile bins (4) one-hot encoded."""
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    st = features.fit_bin_numeric(p, ["p_retailprice"], 4, "quantile", "onehot")
    return features.apply_bin_numeric(p, st)


@query(
    "bin_kmeans_orders",
    """WITH RECURSIVE x AS (SELECT o_totalprice AS v FROM orders), b AS (SELECT min(v) AS lo, max(v) AS hi, 0.0001 * var_pop(v) AS tol FROM x),
lloyd AS (
 SELECT 1 AS it, FALSE AS stop, lo + (hi - lo) / 8 AS c0, lo + 3 * (hi - lo) / 8 AS c1, lo + 5 * (hi - lo) / 8 AS c2, lo + 7 * (hi - lo) / 8 AS c3 FROM b
 UNION ALL
 SELECT it + 1, it = 300 OR (n0 - c0) ** 2 + (n1 - c1) ** 2 + (n2 - c2) ** 2 + (n3 - c3) ** 2 <= tol, n0, n1, n2, n3 FROM (
  SELECT it, tol, c0, c1, c2, c3, coalesce(avg(v) FILTER (v <= (c0 + c1) / 2), c0) AS n0,
   coalesce(avg(v) FILTER (v > (c0 + c1) / 2 AND v <= (c1 + c2) / 2), c1) AS n1,
   coalesce(avg(v) FILTER (v > (c1 + c2) / 2 AND v <= (c2 + c3) / 2), c2) AS n2, coalesce(avg(v) FILTER (v > (c2 + c3) / 2), c3) AS n3
  FROM lloyd, x, b WHERE NOT stop GROUP BY it, tol, c0, c1, c2, c3))
SELECT o_orderkey, CAST((o_totalprice >= (c0 + c1) / 2)::INT + (o_totalprice >= (c1 + c2) / 2)::INT + (o_totalprice >= (c2 + c3) / 2)::INT AS DOUBLE) AS o_totalprice__bin
FROM orders, (SELECT * FROM lloyd WHERE stop)""",
)
def q_bin_km(spark, sf):
    """O40 k-means bins (Lloyd steps over cells of one scan)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    st = features.fit_bin_numeric(o, ["o_totalprice"], 4, "kmeans")
    return features.apply_bin_numeric(o, st)


# ================================================================ O41-O46
@query(
    "semantic_missing_customer",
    cte("dirty_customer")
    + 'SELECT c_custkey, "Customer Name", "Nation-Key", c_acctbal, coalesce(c_mktsegment, \'None\') AS c_mktsegment FROM dirty_customer',
)
def q_semantic(spark, sf):
    """O41 missing text -> category label."""
    d = dirty(spark, sf, "dirty_customer")
    return features.apply_fill(d, features.fit_semantic_missing(d)["mapping"])


@query(
    "missing_indicators_lineitem",
    cte("dirty_lineitem")
    + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity IS NULL)::INT AS l_quantity_was_missing,
 (l_extendedprice IS NULL)::INT AS l_extendedprice_was_missing, (l_returnflag IS NULL)::INT AS l_returnflag_was_missing FROM dirty_lineitem""",
)
def q_indicators(spark, sf):
    """O42 missing indicators for columns with >= 1% missing."""
    d = dirty(spark, sf, "dirty_lineitem")
    out = features.apply_missing_indicators(d, features.fit_missing_indicators(d))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[c for c in out.columns if c.endswith("_was_missing")])


@query(
    "group_rare_documents",
    """WITH m AS (SELECT greatest(5, CAST(round_even(0.05 * count(*), 0) AS BIGINT)) k FROM documents),
ks AS (SELECT source FROM documents GROUP BY source HAVING count(*) >= (SELECT k FROM m)),
kl AS (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= (SELECT k FROM m))
SELECT doc_id, CASE WHEN source IN (SELECT source FROM ks) THEN source ELSE 'Other' END AS source,
 CASE WHEN lang IN (SELECT lang FROM kl) THEN lang ELSE 'Other' END AS lang FROM documents""",
)
def q_rare(spark, sf):
    """O43 rare categories (count < max(5, round(5% of rows))) -> 'Other'."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    st = features.fit_group_rare(d, min_frequency_pct=0.05, columns=["source", "lang"])
    return features.apply_group_rare(d, st)


@query(
    "skew_log1p_events",
    """WITH s AS (SELECT skewness(value) sv, min(value) mv, count(value) nv, count(DISTINCT value) uv,
  skewness(user_id) su, min(user_id) mu, count(user_id) nu, count(DISTINCT user_id) uu,
  skewness(event_id) se, min(event_id) me, count(event_id) ne, count(DISTINCT event_id) ue FROM events)
SELECT
 round(CASE WHEN ue > 10 AND ne >= 10 AND abs(se) > 1.0 AND me >= 0 THEN ln(1 + CASE WHEN event_id < 0 THEN 0 ELSE event_id END) ELSE event_id END, 6) AS event_id,
 round(CASE WHEN uu > 10 AND nu >= 10 AND abs(su) > 1.0 AND mu >= 0 THEN ln(1 + CASE WHEN user_id < 0 THEN 0 ELSE user_id END) ELSE user_id END, 6) AS user_id,
 round(CASE WHEN uv > 10 AND nv >= 10 AND abs(sv) > 1.0 AND mv >= 0 THEN ln(1 + CASE WHEN value < 0 THEN 0 ELSE value END) ELSE value END, 6) AS value
FROM events, s""",
)
def q_skew_log(spark, sf):
    """O44 log1p of skewed numeric columns (auto-selected, G1 > 1)."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    st = features.fit_skewed(ev)
    out = features.apply_skewed(ev, st)
    return out.select(*[r6(F.col(c).cast("double")).alias(c) for c in ["event_id", "user_id", "value"]])


@query(
    "skew_yeo_johnson_events",
    """WITH RECURSIVE u AS (SELECT value AS v, ln(1 + abs(value)) AS u FROM events WHERE value IS NOT NULL),
skew AS (SELECT skewness(v) AS g, count(*) AS n, sum(sign(v) * u) AS s FROM u),
-- halve a bracket by the sign of the likelihood's derivative; its points are neither 0 nor 2
halve AS (
 SELECT 0 AS it, -5.0::DOUBLE AS lo, 5.5::DOUBLE AS hi
 UNION ALL
 SELECT it + 1, CASE WHEN d > 0 THEN mid ELSE lo END, CASE WHEN d > 0 THEN hi ELSE mid END FROM (
  SELECT it, lo, hi, mid, s - n * covar_pop(t, t1) / var_pop(t) AS d FROM (
   SELECT *, CASE WHEN v >= 0 THEN g ELSE -g END AS t, (u * e - g) / p AS t1 FROM (
    SELECT it, lo, hi, mid, n, s, v, u, p, exp(p * u) AS e, (exp(p * u) - 1) / p AS g FROM (
     SELECT it, lo, hi, (lo + hi) / 2 AS mid, n, s, v, u, CASE WHEN v >= 0 THEN (lo + hi) / 2 ELSE 2 - (lo + hi) / 2 END AS p
     FROM halve, skew, u WHERE it < 50)))
  GROUP BY it, lo, hi, mid, n, s)),
l AS (SELECT lo AS lam, n >= 10 AND abs(g) > 1 AS skewed FROM halve, skew WHERE it = 50)
SELECT event_id, round(CASE WHEN NOT skewed THEN value WHEN value >= 0 THEN ((value + 1) ** lam - 1) / lam
  ELSE -((1 - value) ** (2 - lam) - 1) / (2 - lam) END, 4) AS value FROM events, l""",
)
def q_skew_yj(spark, sf):
    """O45 Yeo-Johnson on skewed columns; lambda by maximum likelihood (a
    grid, then Newton steps). The oracle halves a bracket of the derivative;
    values have 4 decimals, as lambda's last digits differ."""
    ev = table(spark, sf, "events").select("event_id", "value")
    st = features.fit_skewed(ev, method="yeo-johnson", columns=["value"])
    return features.apply_skewed(ev, st).withColumn("value", F.round("value", 4))


@query(
    "scale_features_orders",
    cte("dirty_orders")
    + """SELECT round((o_orderkey - avg(o_orderkey) OVER ()) / stddev_pop(o_orderkey) OVER (), 6) AS o_orderkey,
 round((o_custkey - avg(o_custkey) OVER ()) / stddev_pop(o_custkey) OVER (), 6) AS o_custkey,
 round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice,
 price_txt FROM dirty_orders""",
)
def q_scale(spark, sf):
    """O46 standard scaling of numeric columns (missing -> 0 first)."""
    d = dirty(spark, sf, "dirty_orders").select("o_orderkey", "o_custkey", "o_totalprice", "price_txt")
    out = features.apply_scale(d, features.fit_scale(d))
    return out.select(r6("o_orderkey").alias("o_orderkey"), r6("o_custkey").alias("o_custkey"), r6("o_totalprice").alias("o_totalprice"), "price_txt")


# ================================================================= P1-P6
@query(
    "target_distribution_labels",
    cte("labelled_documents")
    + """, c AS (SELECT CAST(quality AS VARCHAR) AS class, count(*) AS count FROM labelled_documents WHERE quality IS NOT NULL GROUP BY 1),
t AS (SELECT sum(count) tot, max(count) mx FROM c)
SELECT class, count, round(count / tot, 6) AS ratio, round(mx / tot, 6) AS max_class_share,
 CASE WHEN mx / tot >= 0.9 THEN 'critical' WHEN mx / tot >= 0.7 THEN 'warning' ELSE 'info' END AS severity FROM c, t""",
)
def q_target_dist(spark, sf):
    """P1/P5 class distribution, max class share and severity."""
    d = quality.class_distribution(dirty(spark, sf, "labelled_documents"), "quality")
    return d.withColumn("ratio", r6("ratio")).withColumn("max_class_share", r6("max_class_share"))


_LEAKY = [("o_orderkey", 0), ("o_totalprice", 1), ("leak_linear", 2), ("o_orderstatus", 3), ("o_orderstatus_copy", 4), ("const_col", 5), ("near_const", 6)]


@query(
    "constant_columns_leaky",
    cte("leaky_orders")
    + "\nUNION ALL\n".join(
        f"""SELECT {i} AS position, '{c}' AS "column", count(DISTINCT {c}) AS n_distinct,
 round((SELECT max(n) FROM (SELECT count(*) n FROM leaky_orders WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}), 6) AS top_ratio,
 count(DISTINCT {c}) <= 1 AS is_constant,
 count(DISTINCT {c}) > 1 AND (SELECT max(n) FROM (SELECT count(*) n FROM leaky_orders WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}) >= 0.99 AS is_near_constant
 FROM leaky_orders"""
        for c, i in _LEAKY
    ),
)
def q_constant(spark, sf):
    """P2 constant / near-constant columns (top share >= 0.99)."""
    return quality.constant_columns(dirty(spark, sf, "leaky_orders")).withColumn("top_ratio", r6("top_ratio"))


def _leak_sql(target, numeric_target):
    parts = []
    for c, _ in _LEAKY:
        if c == target:
            continue
        num_c = c not in ("o_orderstatus", "o_orderstatus_copy", "near_const")
        corr = (
            f"round(CASE WHEN isnan(corr({c}, {target})) THEN NULL ELSE corr({c}, {target}) END, 6)"
            if numeric_target and num_c
            else "CAST(NULL AS DOUBLE)"
        )
        hc = f"coalesce(abs(CASE WHEN isnan(corr({c}, {target})) THEN NULL ELSE corr({c}, {target}) END) >= 0.98, false)" if numeric_target and num_c else "false"
        parts.append(
            f"""SELECT '{c}' AS "column", coalesce(bool_and(CAST({c} AS VARCHAR) = CAST({target} AS VARCHAR)) FILTER (WHERE {c} IS NOT NULL AND {target} IS NOT NULL), false) AS identical,
 {corr} AS corr, {hc} AS high_corr, contains(lower('{c}'), '{target.lower()}') AS name_suspect FROM leaky_orders"""
        )
    return cte("leaky_orders") + "\nUNION ALL\n".join(parts)


@query("leakage_numeric_target", _leak_sql("o_totalprice", True))
def q_leak_num(spark, sf):
    """P3 leakage vs a numeric target: identical values, |corr| >= 0.98, name."""
    return quality.leakage_table(dirty(spark, sf, "leaky_orders"), "o_totalprice").withColumn("corr", r6("corr"))


@query("leakage_text_target", _leak_sql("o_orderstatus", False))
def q_leak_txt(spark, sf):
    """P3 leakage vs a text target (identical copy + name suspect)."""
    return quality.leakage_table(dirty(spark, sf, "leaky_orders"), "o_orderstatus").withColumn("corr", r6("corr"))


@query(
    "feature_selection_advice_lineitem",
    """SELECT count(*) AS n_rows, 10 AS n_features, round(10 / count(*), 6) AS p_over_n,
 CASE WHEN 10 / count(*) >= 1.0 THEN 'critical' WHEN 10 / count(*) >= 0.5 THEN 'warning' ELSE 'info' END AS severity FROM lineitem""",
)
def q_fs_advice(spark, sf):
    """P4 p/n dimensionality check (target l_tax excluded from p)."""
    li = table(spark, sf, "lineitem")
    r = quality.recommend_feature_selection(li, "l_tax")
    ev = r["evidence"]
    return spark.createDataFrame(
        [(ev["n_rows"], ev["n_features"], round(ev["p_over_n"], 6), r["severity"])],
        "n_rows bigint, n_features int, p_over_n double, severity string",
    )


@query(
    "oversampling_labels",
    """WITH c AS (SELECT toxic, count(*) n FROM labels GROUP BY 1)
SELECT count(*) AS nunique, round(max(n) / sum(n), 6) AS max_class_share,
 CASE WHEN max(n) / sum(n) >= 0.9 THEN 'critical' WHEN max(n) / sum(n) >= 0.7 THEN 'warning' ELSE 'info' END AS severity FROM c""",
)
def q_oversampling(spark, sf):
    """P5 oversampling advice on a binary label."""
    r = quality.recommend_oversampling(table(spark, sf, "labels"), "toxic")
    ev = r["evidence"]
    return spark.createDataFrame(
        [(ev["nunique"], round(ev["max_class_share"], 6), r["severity"])], "nunique bigint, max_class_share double, severity string"
    )


_RPT_T = "o_totalprice"
_RPT_CANDS = ["o_orderkey", "leak_linear", "o_orderstatus", "o_orderstatus_copy", "const_col", "near_const"]
_RPT_NUM = ["o_orderkey", "leak_linear", "const_col"]


def _report_sql() -> str:
    """All five checks for leaky_orders with target o_totalprice, written
    independently in SQL (severity rules and message texts)."""
    t, cands, numc = _RPT_T, _RPT_CANDS, _RPT_NUM
    ident = ",\n".join(
        f"coalesce(bool_and(CAST({c} AS VARCHAR) = CAST({t} AS VARCHAR)) FILTER (WHERE {c} IS NOT NULL AND {t} IS NOT NULL), false) AS id_{c}"
        for c in cands
    )
    corr = ",\n".join(
        f"coalesce(abs(CASE WHEN isnan(corr({c}, {t})) THEN NULL ELSE corr({c}, {t}) END) >= 0.98, false) AS hc_{c}" for c in numc
    )
    quote = "'"
    id_items = ", ".join(f"CASE WHEN id_{c} THEN '{quote}{quote}{c}{quote}{quote}' END" for c in cands)
    any_id = " OR ".join(f"id_{c}" for c in cands)
    any_hc = " OR ".join(f"hc_{c}" for c in numc)
    any_name = " OR ".join(f"contains(lower('{c}'), '{t}')" for c in cands)
    const = " + ".join(f"(SELECT (count(DISTINCT {c}) <= 1)::INT FROM leaky_orders)" for c in cands)
    near = " + ".join(
        f"(SELECT (count(DISTINCT {c}) > 1 AND (SELECT max(n) FROM (SELECT count(*) n FROM leaky_orders "
        f"WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}) >= 0.99)::INT FROM leaky_orders)"
        for c in cands
    )
    p = len(cands)
    return cte("leaky_orders") + f""", lk AS (SELECT {ident},
{corr} FROM leaky_orders),
nu AS (SELECT count(DISTINCT {t}) AS n, count(*) AS n_rows FROM leaky_orders),
cc AS (SELECT {const} AS n_const, {near} AS n_near)
SELECT 'check_target_distribution' AS code, 'info' AS severity,
 'Target appears continuous (nunique=' || n || '). Review distribution before regression.' AS message FROM nu WHERE n > 20
UNION ALL
SELECT 'flag_leakage', CASE WHEN {any_id} OR {any_hc} THEN 'critical' WHEN {any_name} THEN 'warning' ELSE 'info' END,
 CASE WHEN {any_id} THEN 'Found features identical to target: [' || concat_ws(', ', {id_items}) || '] (strong leakage).'
      WHEN {any_hc} THEN 'Found highly correlated numeric features with target (|corr|>=0.98). Potential leakage.'
      ELSE 'No strong leakage signals detected.' END FROM lk
UNION ALL
SELECT 'flag_redundant_or_constant_features', CASE WHEN n_const >= 5 THEN 'critical' WHEN n_const >= 1 THEN 'warning' ELSE 'info' END,
 'Found ' || n_const || ' constant columns and ' || n_near || ' near-constant columns (top value ratio >= 0.99). Consider dropping or reviewing them.' FROM cc
UNION ALL
SELECT 'recommend_feature_selection', CASE WHEN {p} / n_rows >= 1.0 THEN 'critical' WHEN {p} / n_rows >= 0.5 THEN 'warning' ELSE 'info' END,
 'Feature selection may be beneficial: p={p} features, n=' || n_rows || ' rows (p/n=' || printf('%.2f', {p} / n_rows) || '). Consider dropping redundant/constant features or using regularization.' FROM nu"""


@query("quality_report_leaky_orders", _report_sql())
def q_report(spark, sf):
    """P6 all checks in the reference order as (code, severity, message); the
    evidence JSON column of the report is left out of the comparison."""
    return quality.quality_report(dirty(spark, sf, "leaky_orders"), "o_totalprice").select("code", "severity", "message")


# ================================================================= L1-L7
_NAME_NORM = _ddb_collapse("lower(" + _ddb_strip('"Customer Name"') + ")")
_SEG_NORM = _ddb_collapse("lower(" + _ddb_strip("c_mktsegment") + ")")


@query(
    "plan_run_deterministic_customer",
    cte("dirty_customer")
    + f""", n AS (SELECT c_custkey, {_NAME_NORM} AS customer_name, "Nation-Key" AS nation_key, c_acctbal, {_SEG_NORM} AS c_mktsegment FROM dirty_customer),
md AS (SELECT v FROM (SELECT c_mktsegment v, count(*) c FROM n WHERE c_mktsegment IS NOT NULL GROUP BY 1) ORDER BY c DESC, v LIMIT 1)
SELECT c_custkey, customer_name, nation_key, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM n)), 6) AS c_acctbal,
 coalesce(c_mktsegment, (SELECT v FROM md)) AS c_mktsegment FROM n""",
)
def q_plan_run(spark, sf):
    """L3 audited plan run of the fixed recipe (names, normalise, dedup, impute)."""
    out, _, _ = run_plan(dirty(spark, sf, "dirty_customer"), deterministic_plan(), audit=False)
    return out.withColumn("c_acctbal", r6("c_acctbal"))


@query(
    "plan_fit_transform_customer",
    cte("dirty_customer")
    + """, med AS (SELECT median(c_acctbal) m FROM dirty_customer)
SELECT c_custkey, "Nation-Key" AS nation_key, round(coalesce(c_acctbal, (SELECT m FROM med)), 6) AS c_acctbal,
 (c_acctbal IS NULL)::INT AS c_acctbal_was_missing, (c_mktsegment IS NULL)::INT AS c_mktsegment_was_missing,
 (dense_rank() OVER (ORDER BY "Customer Name") - 1)::DOUBLE AS customer_name__ord,
 (dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1)::DOUBLE AS c_mktsegment__ord FROM dirty_customer""",
)
def q_plan_fit(spark, sf):
    """L1/L2 fit a plan (names, indicators, median impute, ordinal) and replay it."""
    plan = Plan(
        actions=[
            Action("fix_column_names"),
            Action("add_missing_indicators"),
            Action("handle_missing", params={"strategy": "median"}),
            Action("encode_categorical", params={"method": "ordinal"}),
        ]
    )
    d = dirty(spark, sf, "dirty_customer")
    model = PlanCleaner(plan).fit(d)
    return model.transform(d).withColumn("c_acctbal", r6("c_acctbal"))


def _suggest_sql() -> str:
    cols = [("c_custkey", False), ("Customer Name", True), ("Nation-Key", False), ("c_acctbal", False), ("c_mktsegment", True)]
    stats = " UNION ALL ".join(
        f"""SELECT {i} AS pos, '{c}' AS c, {txt} AS txt, count(DISTINCT "{c}") AS u, count(*) AS n, count(*) - count("{c}") AS m FROM dirty_customer"""
        for i, (c, txt) in enumerate(cols)
    )
    return cte("dirty_customer") + rf""", s AS ({stats}),
j AS (SELECT *, regexp_matches(lower(c), '(^|[\W_])(id|nbr|key)($|[\W_])') OR u = n OR m / n > 0.4 AS gone FROM s),
a AS (SELECT 0 AS o, 'fix_column_names' AS action, '' AS target_columns
 UNION ALL SELECT 1, 'drop_column', string_agg(c, ',' ORDER BY pos) FROM j WHERE gone HAVING count(*) > 0
 UNION ALL SELECT 2, 'normalize_text', ''
 UNION ALL SELECT 3, 'handle_missing', string_agg(c, ',' ORDER BY pos) FROM j WHERE NOT gone AND m > 0 HAVING count(*) > 0
 UNION ALL SELECT 4, 'clip_outliers', ''
 UNION ALL SELECT 5, 'encode_categorical_per_column', '' FROM j WHERE NOT gone AND txt HAVING count(*) > 0
 UNION ALL SELECT 6, 'scale_features', '')
SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS step, action, target_columns FROM a"""


@query("plan_suggest_customer", _suggest_sql())
def q_suggest(spark, sf):
    """L7 profile-driven plan suggestion (actions as rows)."""
    p = suggest_plan(dirty(spark, sf, "dirty_customer"))
    rows_ = [(i, a.action, ",".join(a.target_columns)) for i, a in enumerate(p.actions)]
    return spark.createDataFrame(rows_, "step int, action string, target_columns string")


@query(
    "plan_suggested_customer",
    cte("dirty_customer")
    + """SELECT engine, "column", n_rows FROM (SELECT count(*) AS n_rows FROM dirty_customer), (VALUES ('runner'), ('cleaner')) e(engine), (VALUES ('c_acctbal'), ('c_mktsegment__ord')) c("column")""",
)
def q_suggested(spark, sf):
    """L7 with L1 and L3: the plan suggested for trees carried out by the
    runner and by the cleaner. Keys and names of single customers go, also
    after the columns were renamed; the rows and the rest stay."""
    d = dirty(spark, sf, "dirty_customer")
    plan = suggest_plan(d, model_family="tree")
    done = {"runner": run_plan(d, plan, audit=False)[0], "cleaner": PlanCleaner(plan).fit(d).transform(d)}
    rows_ = [(engine, c, out.count()) for engine, out in done.items() for c in out.columns]
    return spark.createDataFrame(rows_, "engine string, column string, n_rows long")


_AUDIT_SQL = cte("dirty_customer") + f""", n AS (SELECT "Customer Name" AS c0, c_mktsegment AS s0, {_NAME_NORM} AS c, {_SEG_NORM} AS s FROM dirty_customer),
ch AS (SELECT count_if(c <> c0) AS dc, count_if(s <> s0) AS ds FROM n),
md AS (SELECT s AS v FROM n WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1),
nm AS (SELECT c AS v, row_number() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT c FROM n WHERE c IS NOT NULL)),
sg AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM (SELECT DISTINCT coalesce(s, (SELECT v FROM md)) AS v FROM n)),
mp AS (SELECT (SELECT CASE WHEN count(*) > 1000 THEN '{{"values": ' || count(*) || ', "table": ""}}' ELSE '{{' || string_agg('"' || v || '": ' || k, ', ' ORDER BY k) || '}}' END FROM nm) AS names,
 (SELECT '{{' || string_agg('"' || v || '": ' || k, ', ' ORDER BY k) || '}}' FROM sg) AS segments)
SELECT 0 AS step_id, 'normalize_text' AS action_name, 'applied' AS status, '{{"columns_normalized": ["Customer Name", "c_mktsegment"], "values_changed_count": {{"Customer Name": ' || dc
 || ', "c_mktsegment": ' || ds || '}}, "null_like_converted_to_nan": {{}}, "replacements_applied": {{}}}}' AS diff_summary FROM ch
UNION ALL SELECT 1, 'handle_missing', 'applied', '{{"imputation_values": {{"c_acctbal": "MICE_Estimated", "c_mktsegment": "' || v || '"}}}}' FROM md
UNION ALL SELECT 2, 'drop_column', 'applied', '{{"reason": null, "requested": ["Nation-Key", "not_there"], "dropped": ["Nation-Key"], "missing": ["not_there"], "cols_before": 5, "cols_after": 4}}'
UNION ALL SELECT 3, 'encode_categorical', 'applied', '{{"method": "ordinal", "encoded_columns": ["Customer Name", "c_mktsegment"], "dropped_original_columns": ["Customer Name", "c_mktsegment"], "created_columns": ["Customer Name__ord", "c_mktsegment__ord"], "mappings": {{"Customer Name": '
 || names || ', "c_mktsegment": ' || segments || '}}, "unknown_handling": "ignore"}}' FROM mp"""


@query("plan_audit_customer", _AUDIT_SQL)
def q_audit(spark, sf):
    """L3/L4 provenance records of an eager plan run (one row per action)."""
    from sparkprep.plans.runner import provenance_frame

    plan = Plan(
        actions=[
            Action("encode_categorical", params={"method": "ordinal"}),
            Action("normalize_text"),
            Action("handle_missing", params={"strategy": "impute"}),
            Action("drop_column", target_columns=["Nation-Key", "not_there"]),
        ]
    )
    _, _, steps = run_plan(dirty(spark, sf, "dirty_customer"), plan, dataset_id="dirty_customer")
    # where a table of codes lies is another place in every run
    diff = F.regexp_replace("diff_summary", r'"table": "[^"]*"', '"table": ""')
    return provenance_frame(spark, steps).select("step_id", "action_name", "status", diff.alias("diff_summary"))


# ================================================================== O1-O5
@query(
    "read_csv_customer",
    cte("dirty_customer")
    + """SELECT c_custkey, "Customer Name", CAST("Nation-Key" AS BIGINT) AS "Nation-Key", c_acctbal,
 CASE WHEN c_mktsegment IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN',
  '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null', 'HOUSEHOLD') THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM dirty_customer""",
)
def q_csv(spark, sf):
    """O1/O5 write a table as CSV to the shared scratch folder and read it
    back with pandas-style missing markers plus a user marker."""
    from sparkprep.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"csv-{uuid.uuid4().hex}")
    io.write_table(dirty(spark, sf, "dirty_customer"), path, "csv")
    return io.read_csv(spark, path, na_values=["HOUSEHOLD"])


@query("preview_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def q_preview(spark, sf):
    """O4 deterministic preview (top-k)."""
    return io.preview(table(spark, sf, "orders"), 20, ["o_orderkey"])


# ===================================================================== O18
@query(
    "json_recover_events",
    """SELECT event_id, replace(props, ' ', '') AS json, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 4 ELSE 6 END::INTEGER AS recovery_stage
FROM events""",
)
def q_json(spark, sf):
    """O18 JSON recovery over model-like text built from events.props
    (fenced, prose-wrapped, single-quoted, trailing comma, truncated)."""
    ev = table(spark, sf, "events").select("event_id", "props")
    k = F.col("event_id") % 6
    wrapped = (
        F.when(k == 0, F.col("props"))
        .when(k == 1, F.concat(F.lit("Result:\n```json\n"), F.col("props"), F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" hope it helps")))
        .when(k == 3, F.translate(F.col("props"), '"', "'"))
        .when(k == 4, F.regexp_replace(F.col("props"), "}$", ",}"))
        .otherwise(F.regexp_replace(F.col("props"), "}$", ""))
    )
    r = with_recovered_json(ev.select("event_id", wrapped.alias("raw")), "raw")
    return r.select("event_id", F.to_json("json").alias("json"), "recovery_stage")


@query(
    "json_recover_numbers_events",
    """SELECT event_id, CASE event_id % 4
  WHEN 0 THEN '{"k":' || json_extract_string(props, '$.k') || ',"x":null}'
  WHEN 1 THEN '{"k":7,"x":[null,null,1]}'
  WHEN 2 THEN '{"k":' || json_extract_string(props, '$.k') || ',"s":"NaN, -Infinity"}'
  ELSE '{"k":' || json_extract_string(props, '$.k') || ',"x":[null]}' END AS json,
 CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 6 END::INTEGER AS recovery_stage FROM events""",
)
def q_json_numbers(spark, sf):
    """O18 repeated keys (the last value stays) and numbers that JSON lacks,
    whole, inside prose and cut off."""
    ev = table(spark, sf, "events").select("event_id", "props")
    k, rest = F.col("event_id") % 4, F.regexp_replace("props", r"^\{|\}$", "")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"x": 1, '), rest, F.lit(', "x": NaN}')))
        .when(k == 1, F.concat(F.lit("{"), rest, F.lit(', "x": [Infinity, -Infinity, 1], "k": 7}')))
        .when(k == 2, F.concat(F.lit('Like {"k": 0, "s": "NaN, -Infinity", '), rest, F.lit("} here")))
        .otherwise(F.concat(F.lit("{"), rest, F.lit(', "x": [NaN')))
    )
    r = with_recovered_json(ev.select("event_id", raw.alias("raw")), "raw")
    return r.select("event_id", F.to_json("json").alias("json"), "recovery_stage")


# =============================================================== X1, X2
@query(
    "stream_transform_events",
    """WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events),
c AS (SELECT event_id, event_type, CASE WHEN q3 - q1 = 0 THEN value
  WHEN value < q1 - 3.0 * (q3 - q1) THEN q1 - 3.0 * (q3 - q1) WHEN value > q3 + 3.0 * (q3 - q1) THEN q3 + 3.0 * (q3 - q1) ELSE value END AS value FROM events, q),
s AS (SELECT skewness(value) g, min(value) mn, count(value) n FROM c),
t AS (SELECT event_id, CASE WHEN n >= 10 AND abs(g) > 1.0 AND mn >= 0 THEN ln(1 + CASE WHEN value < 0 THEN 0 ELSE value END) ELSE value END AS value FROM c, s),
k AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0 END AS event_type_click, CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0 END AS event_type_error,
  CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0 END AS event_type_purchase, CASE WHEN event_type = 'signup' THEN 1.0::DOUBLE ELSE 0.0 END AS event_type_signup,
  CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.0 END AS event_type_view FROM events)
SELECT t.event_id, round(t.value, 6) AS value, k.* EXCLUDE (event_id) FROM t JOIN k USING (event_id)""",
)
def q_stream(spark, sf):
    """X1 a plan model fitted on the batch table applied to the same table
    read as a file stream (clip, log1p, one-hot)."""
    from sparkprep.streaming.apply import run_to_table, transform_stream
    from sparkprep.session import ensure_checkpoint_dir

    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    plan = Plan(
        actions=[
            Action("clip_outliers", params={"columns": ["value"]}),
            Action("transform_numeric_skewed", params={"columns": ["value"]}),
            Action("encode_categorical", params={"method": "one_hot", "columns": ["event_type"]}),
        ]
    )
    model = PlanCleaner(plan).fit(ev)
    stream = (
        spark.readStream.schema(table(spark, sf, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select("event_id", "event_type", "value")
    )
    folder = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    return run_to_table(transform_stream(stream, model), folder).withColumn("value", r6("value"))


@query(
    "stream_dedup_events",
    "SELECT DISTINCT user_id, event_type, epoch_us(ts) AS ts_us FROM events",
)
def q_stream_dedup(spark, sf):
    """X2 streaming dedup on (user_id, event_type, ts): every event arrives
    twice, in two files read by separate micro-batches. The watermark is
    wider than the events, so no row counts as late."""
    from sparkprep.streaming.apply import dedup_stream, run_to_table
    from sparkprep.session import ensure_checkpoint_dir

    folder = os.path.join(ensure_checkpoint_dir(spark), f"dedup-{uuid.uuid4().hex}")
    ev = table(spark, sf, "events").select("user_id", "event_type", "ts")
    for _ in range(2):
        ev.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept = dedup_stream(stream, ["user_id", "event_type", "ts"], "ts", delay="36500 days")
    return run_to_table(kept, folder).select("user_id", "event_type", F.unix_micros("ts").alias("ts_us"))


# ============================================================ more O3/O5/P1
@query(
    "write_json_parquet_roundtrip_customer",
    cte("dirty_customer") + 'SELECT c_custkey, "Customer Name", "Nation-Key", c_acctbal, c_mktsegment FROM dirty_customer',
)
def q_roundtrip(spark, sf):
    """O5 sinks: the dirty customer table written as JSON and as Parquet to
    the shared scratch folder, read back, and the two copies joined on the
    key (the Parquet copy supplies the columns, the JSON copy must match)."""
    from sparkprep.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark)
    d = dirty(spark, sf, "dirty_customer")
    pj = os.path.join(base, f"json-{uuid.uuid4().hex}")
    pp = os.path.join(base, f"parquet-{uuid.uuid4().hex}")
    io.write_table(d, pj, "json")
    io.write_table(d, pp, "parquet")
    pq = io.read_parquet(spark, pp)
    js = spark.read.schema(d.schema).json(pj)
    same = pq.alias("p").join(js.alias("j"), "c_custkey").filter(
        F.col("p.`Customer Name`").eqNullSafe(F.col("j.`Customer Name`"))
        & F.col("p.c_acctbal").eqNullSafe(F.col("j.c_acctbal"))
        & F.col("p.c_mktsegment").eqNullSafe(F.col("j.c_mktsegment"))
        & F.col("p.`Nation-Key`").eqNullSafe(F.col("j.`Nation-Key`"))
    )
    return same.select("c_custkey", "p.`Customer Name`", "p.`Nation-Key`", "p.c_acctbal", "p.c_mktsegment")


@query(
    "target_regression_stats_orders",
    """SELECT count(o_totalprice) AS count, count(*) - count(o_totalprice) AS missing, round(avg(o_totalprice), 6) AS mean,
 round(stddev_pop(o_totalprice), 6) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max,
 count(DISTINCT o_totalprice) AS nunique FROM orders""",
)
def q_target_reg(spark, sf):
    """P1 regression-like branch: a target with more than 20 distinct
    values reports count, missing, mean, population std, min and max."""
    r = quality.check_target_distribution(table(spark, sf, "orders"), "o_totalprice")
    st = r["evidence"]["stats"]
    n = quality.class_counts(table(spark, sf, "orders"), "o_totalprice")[0]
    return spark.createDataFrame(
        [(st["count"], st["missing"], round(st["mean"], 6), round(st["std"], 6), st["min"], st["max"], n)],
        "count bigint, missing bigint, mean double, std double, min double, max double, nunique bigint",
    )


@query(
    "profile_approx_lineitem",
    cte("dirty_lineitem")
    + "".join(
        f"{' UNION ALL ' if i else ''}SELECT {i}::INTEGER AS position, '{c}' AS \"column\", count(*) - count({c}) AS missing_count, true AS n_unique_near FROM dirty_lineitem"
        for i, c in enumerate(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    ),
)
def q_profile_approx(spark, sf):
    """O23 scale mode: profile without the value-count shuffle. Missing counts
    are exact; the HyperLogLog distinct counts are checked to be within four
    standard errors (20 %) of the exact ones."""
    d = dirty(spark, sf, "dirty_lineitem")
    p = profile.profile(d, approx=True)
    exact = d.agg(*[F.count_distinct(F.col(c)).alias(c) for c in d.columns]).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in d.columns])).alias("x")
    )
    near = F.abs(F.col("n_unique") - F.col("exact")) <= F.greatest(F.lit(1), 0.2 * F.col("exact"))
    return p.join(exact.select("x.*"), "column").select("position", "column", "missing_count", near.alias("n_unique_near"))
