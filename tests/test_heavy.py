"""Heavy hitters against plain counts: errors of merged summaries, exact counts, fallback, odd columns."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkprep.operators import heavy, quality
from sparkprep.operators.impute import fit_mode
from sparkprep.operators.profile import top_values, value_counts_long


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=6), st.integers(1, 8))
def test_merged_summaries_keep_their_error(parts, counters):
    whole, true = heavy.Summary.empty(), Counter()
    for values in parts:
        own = heavy.Summary.empty()
        for half in (values[::2], values[1::2]):
            if half:
                own.add(*np.unique(np.array(half, np.int64), return_counts=True), len(half), 0, counters)
        whole.add(own.hashes, own.counts, own.n, own.error, counters)
        true.update(values)
    n = sum(true.values())
    listed = dict(zip(whole.hashes.tolist(), whole.counts.tolist()))
    assert whole.n == n and len(listed) <= counters and whole.error <= n / (counters + 1)
    for value, count in true.items():
        assert listed.get(value, 0) <= count <= listed.get(value, 0) + whole.error


def _rows(df):
    return {(r["column"], r["value"], r["cnt"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 7])
def test_top_counts_equal_full_counts(spark, parts):
    df = spark.range(0, 6000, 1, parts).select(
        F.col("id").alias("unique"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("hot"),
        F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("id") % 5 + 0.5).alias("number"),
        F.lit(None).cast("string").alias("empty"),
        F.array(F.col("id") % 4).alias("nested"),
        F.create_map(F.lit("k"), F.col("id") % 2).alias("entries"),
        (F.col("id") % 2 == 0).alias("flag"),
        (F.col("id") % 300).cast("decimal(20,2)").alias("dec"),
    )
    for k, counters in ((1, 4), (3, 8), (3, 64)):
        want = _rows(top_values(value_counts_long(df), k))
        assert _rows(heavy.top_counts(df, df.columns, k, counters)) == want
    assert heavy.top_counts(df.limit(0), df.columns).count() == 0
    assert fit_mode(df, ["hot", "empty"]) == {"hot": "7", "empty": None}


def test_near_constant_by_heavy_hitters_and_by_full_counts(spark):
    df = spark.range(2000).select(
        F.col("id").alias("unique"),
        F.lit("x").alias("same"),
        F.lit(None).cast("double").alias("none"),
        F.when(F.col("id") < 1980, F.lit("a")).otherwise(F.lit("b")).alias("edge"),
        F.when(F.col("id") < 1979, F.lit("a")).otherwise(F.lit("b")).alias("below"),
        F.when(F.col("id") > 3, F.lit(1.5)).alias("gaps"),
        F.array(F.lit(1)).alias("list"),
        (F.lit("90071992547409930").cast("decimal(20,0)") + F.col("id") % 2).alias("digits"),
    )
    by_heavy = quality.flag_redundant_or_constant_features(df, None)
    assert by_heavy == quality.flag_redundant_or_constant_features(df, None, vc=value_counts_long(df))
    assert by_heavy["evidence"]["constant_columns"] == ["same", "none", "gaps", "list"]
    assert by_heavy["evidence"]["near_constant_columns"] == [{"column": "edge", "top_ratio": 0.99}]
    assert quality.flag_redundant_or_constant_features(df.limit(0), None)["evidence"]["counts"] == {"constant": 8, "near_constant": 0}
    low = quality.flag_redundant_or_constant_features(df, None, {"near_constant_threshold": 0.005})
    assert "unique" not in [c["column"] for c in low["evidence"]["near_constant_columns"]]
