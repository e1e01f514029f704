"""Frozen tables: both joins give what a map gives, hot and missing values are spread, states survive saving."""

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import encode, features, lookup
from sparkprep.plans.cleaner import PlanCleaner, PlanModel
from sparkprep.plans.spec import Action, Plan


@pytest.fixture
def table(spark):
    value = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.format_string("v%04d", F.col("id") % 1900))
    return spark.range(0, 6000, 1, 6).select("id", value.alias("a.b c"), F.lit("x").alias("__key_"))


@pytest.fixture
def no_own_broadcast(spark):
    """Spark broadcasts nothing but what it is told to."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("limit", [lookup.BROADCAST_BYTES, -1])
def test_codes_are_those_of_a_literal_map(spark, table, limit, monkeypatch, no_own_broadcast):
    monkeypatch.setattr(encode, "MAP_LIMIT", 10**6)
    by_map = {o: encode.ordinal(table, ["a.b c"], o).df.collect() for o in ("alphabetical", "frequency")}
    monkeypatch.setattr(encode, "MAP_LIMIT", 10)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    for order, want in by_map.items():
        got = encode.ordinal(table, ["a.b c"], order)
        assert got.df.columns == ["id", "__key_", "a.b c__ord"] and sorted(got.df.collect()) == sorted(want)
        named = got.diff["mappings"]["a.b c"]
        assert spark.read.parquet(named["table"]).count() == named["values"] == len({r["a.b c__ord"] for r in want}) - 1
        plan = got.df._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (limit > 0)
    fresh = spark.createDataFrame([("hot",), ("new",), (None,)], "`a.b c` string")
    state = encode.fit_ordinal_stage(table, ["a.b c"])
    assert lookup.is_frozen(state["a.b c"])
    codes = [r[0] for r in encode.apply_ordinal_stage(fresh, state).collect()]
    assert sorted(codes) == sorted([0.0, -1.0, 1.0])  # hot, unknown, and "nan" for the missing


@pytest.mark.parametrize("limit", [lookup.BROADCAST_BYTES, -1])
def test_rare_values_by_a_frozen_table(table, limit, monkeypatch, no_own_broadcast):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
    want = features.apply_group_rare(table, features.fit_group_rare(table, min_frequency_pct=0.0, min_frequency_abs=2)).collect()
    monkeypatch.setattr(features, "ISIN_LIMIT", 5)
    state = features.fit_group_rare(table, min_frequency_pct=0.0, min_frequency_abs=2)
    assert lookup.is_frozen(state["keep_map"]["a.b c"])
    assert sorted(features.apply_group_rare(table, state).collect(), key=str) == sorted(want, key=str)


def test_rows_without_a_join_are_spread(table, monkeypatch, no_own_broadcast):
    monkeypatch.setattr(encode, "MAP_LIMIT", 10)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)
    state = encode.fit_ordinal(table, ["a.b c"])["a.b c"]
    assert "hot" in state[2]["hot"] and len(state[2]["hot"]) == lookup.HOT
    spark = table.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookup.look_up(table, F.col("`a.b c`"), state, "code")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(sizes) == 6000 and max(sizes) < 6000 / 3


def test_saved_state_equals_the_fitted_one(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr(encode, "MAP_LIMIT", 10)
    plan = Plan(actions=[Action("encode_categorical", params={"method": "ordinal", "columns": ["a.b c"]})])
    model = PlanCleaner(plan).fit(table)
    model.save(str(tmp_path / "m"))
    again = PlanModel.load(spark, str(tmp_path / "m"))
    assert sorted(again.transform(table).collect()) == sorted(model.transform(table).collect())


def test_handle_unknown_is_checked(table):
    with pytest.raises(ValueError, match="handle_unknown"):
        encode.ordinal(table, ["a.b c"], handle_unknown="sometimes")
