"""Whole rows by fingerprints first, against full grouping; every column type, any bound of the broadcast."""

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import distinct, heavy
from sparkprep.operators.profile import overview
from sparkprep.operators.rows import deduplicate


@pytest.fixture
def table(spark):
    rows = spark.range(0, 600, 1, 5)
    third = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 150)
    return rows.select(
        third.cast("int").alias("n"),
        F.when(third == -1, F.lit(float("nan"))).otherwise(third / 2).alias("x"),
        F.when(third > 70, F.concat(F.lit("t"), third)).alias("t"),
        F.array(third, F.lit(None).cast("bigint")).alias("a b"),
        F.create_map(F.lit("k"), third, F.lit("j"), F.lit(1).cast("bigint")).alias("m"),
        F.encode(third.cast("string"), "UTF-8").alias("raw"),
        third.cast("decimal(30,3)").alias("dec"),
    )


@pytest.mark.parametrize("most", [None, 3])
def test_distinct_rows(table, most, monkeypatch):
    if most:
        monkeypatch.setattr(distinct, "BROADCAST_PRINTS", most)
    plain = table.select("n").distinct().count()
    first = deduplicate(table, keep="first").df
    assert first.columns == table.columns and first.schema["m"].dataType == table.schema["m"].dataType
    got = first.collect()
    assert len(got) == plain == len({r["n"] for r in got})
    hot = [r for r in got if r["n"] == -1][0]
    assert hot["x"] != hot["x"] and hot["m"] == {"k": -1, "j": 1} and hot["t"] is None
    alone = table.groupBy("n").count().filter("count = 1").count()
    assert deduplicate(table, keep="none").df.count() == alone
    found = overview(table).first()
    assert (found["rows"], found["duplicate_rows"]) == (600, 600 - plain)
    assert found["total_missing"] == table.filter("isnan(x)").count() + table.filter("t is null").count()
    empty = overview(table.limit(0)).first()
    assert (empty["rows"], empty["total_missing"], empty["duplicate_rows"]) == (0, 0, 0)
    assert deduplicate(table.limit(0)).df.count() == 0


def test_rows_that_differ_in_the_place_of_a_null_only(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, None), (None, 1)], "a int, b int")
    prints = df.select(*distinct.row_print(df)).distinct().count()
    assert prints == 3 and overview(df).first()["duplicate_rows"] == 1


def test_equal_fingerprints_of_different_rows(spark, monkeypatch):
    monkeypatch.setattr(distinct, "row_print", lambda df: [F.lit(1).cast("bigint").alias("p0"), F.lit(2).cast("bigint").alias("p1")])
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "a int")
    assert {r["a"] for r in deduplicate(df).df.collect()} == {1, 2, None}
    assert overview(df).first()["duplicate_rows"] == 1
    assert {r["a"] for r in deduplicate(df, keep="none").df.collect()} == {1, None}


def test_few_distinct(spark):
    df = spark.range(0, 400, 1, 7).select(
        (F.col("id") % 10 + 0.5).alias("ten"), (F.col("id") % 11 + 0.5).alias("eleven"), F.lit(None).cast("double").alias("none")
    )
    assert heavy.few_distinct(df, df.columns, 10) == {"ten", "none"}
