import json
import math

import pytest
from pyspark.sql import functions as F

from sparkprep.functions.jsonfix import close_truncated, with_recovered_json
from sparkprep.operators import features, outliers, profile, rows
from sparkprep.plans.cleaner import PlanCleaner, PlanModel, register_action
from sparkprep.plans.runner import RANK, run_plan
from sparkprep.plans.spec import ACTIONS, Action, Plan
from sparkprep.plans.suggest import suggest_plan
from sparkprep.sources import io

NAN = float("nan")


@pytest.fixture(scope="module")
def floats(spark):
    return spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 1000.0), (5, NAN), (6, None)], "k int, x double")


def test_clip_leaves_missing_values(floats):
    for out in (outliers.apply_clip(floats.select("x"), {"x": (0.0, 10.0)}), outliers.remove_outliers(floats, ["x"], iqr_k=0.5, mode="clip").df):
        got = [r.x for r in out.collect()]
        assert sum(v is not None and math.isnan(v) for v in got) == 1 and None in got
        assert max(v for v in got if v is not None and not math.isnan(v)) < 1000


def test_dropping_rows_counts_them_when_the_audit_is_read(floats):
    r = outliers.remove_outliers(floats, ["x"], iqr_k=0.5)
    assert r.df.count() == 5 and r.diff["rows_removed"] == 1 and r.warnings == []
    none = outliers.remove_outliers(floats.where("k < 4"), ["x"])
    assert none.diff["rows_removed"] == 0 and any("no outliers" in w for w in none.warnings)


def test_nan_and_null_are_the_same_missing_value(spark):
    df = spark.createDataFrame([("a", NAN), ("a", None), ("b", 1.0)], "s string, x double")
    assert rows.deduplicate(df).df.count() == 2
    assert rows.deduplicate(df, ["s", "x"]).df.count() == 2
    assert rows.deduplicate(df, ["x"], keep="none").df.count() == 1
    assert profile.overview(df).first().duplicate_rows == 1


def test_a_column_without_values_has_no_bins(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, NAN), (3.0, None)], "a double, b double")
    for strategy in ("quantile", "uniform", "kmeans"):
        state = features.fit_bin_numeric(df, ["a", "b"], 2, strategy)
        assert state["cols"] == ["a"] and features.apply_bin_numeric(df, state).columns == ["b", "a__bin"]


def test_nan_is_no_rare_value(spark):
    df = spark.createDataFrame([(1.0,)] * 20 + [(NAN,), (2.0,), (None,)], "x double")
    state = features.fit_group_rare(df, columns=["x"], min_frequency_abs=5)
    got = [r.x for r in features.apply_group_rare(df, state).collect()]
    assert got.count(None) == 2 and got.count("Other") == 1


def test_every_indicator_is_added_by_default(spark):
    df = spark.createDataFrame([tuple([None] * 30), tuple([1] * 30)], ", ".join(f"c{i} int" for i in range(30)))
    assert len(features.fit_missing_indicators(df)["indicator_cols"]) == 30
    few = features.fit_missing_indicators(df, max_indicators=3)
    assert len(few["indicator_cols"]) == 3 and len(few["left_out"]) == 27


def test_every_known_action_runs_in_the_runner(spark, toy):
    assert set(ACTIONS) <= set(RANK)
    params = {
        "cast_type": {"columns": ["age"], "dtype": "float"},
        "drop_column": {"columns": ["education"]},
        "bin_numeric": {"columns": ["hours_per_week"], "n_bins": 2},
        "encode_categorical": {"method": "ordinal", "columns": ["workclass"]},
        "remove_outliers": {"columns": ["hours_per_week"]},
        "handle_missing": {"columns": ["age"], "strategy": "median"},
        "normalize_text": {"columns": ["workclass"]},
    }
    for name in ACTIONS:
        out, results, steps = run_plan(toy, Plan(actions=[Action(name, params=params.get(name, {}))]), target_column="income")
        assert results[0][1] == "Applied", results
        assert out.count() > 0 and steps[0]["status"] == "applied"


def test_unknown_actions_are_skipped_unless_registered(spark, toy):
    plan = Plan(actions=[Action("shout")])
    assert PlanCleaner(plan).fit(toy).skipped == ["shout"]
    assert run_plan(toy, plan)[1][0][1] == "Not implemented"
    register_action("shout", lambda df, p, tc, t: (df.withColumn("loud", F.lit(1)), {}), lambda df, st: df.withColumn("loud", F.lit(1)))
    try:
        assert "loud" in PlanCleaner(plan).fit(toy).transform(toy).columns
        assert "loud" in run_plan(toy, plan)[0].columns
    finally:
        from sparkprep.plans.cleaner import STAGES

        del STAGES["shout"]


def test_plans_find_columns_after_they_were_renamed(spark):
    df = spark.createDataFrame([(i, f"name {i}", "x" if i % 2 else "y", float(i)) for i in range(8)], "`Row-Id` int, `Full Name` string, Kind string, label double")
    plan = suggest_plan(df, model_family="tree")
    drop = next(a for a in plan.actions if a.action == "drop_column")
    assert set(drop.target_columns) == {"Row-Id", "Full Name"}
    for out in (run_plan(df, plan)[0], PlanCleaner(plan).fit(df).transform(df)):
        assert not {"row_id", "full_name"} & set(out.columns) and "label" in out.columns


def test_decimal_state_is_saved(spark, tmp_path):
    from decimal import Decimal

    df = spark.createDataFrame([(Decimal("1.50"),), (None,), (Decimal("2.50"),)], "d decimal(10,2)")
    model = PlanCleaner(Plan(actions=[Action("handle_missing", params={"strategy": "mean"})])).fit(df)
    model.save(str(tmp_path / "m"))
    again = PlanModel.load(spark, str(tmp_path / "m"))
    assert sorted(map(str, again.transform(df).collect())) == sorted(map(str, model.transform(df).collect()))


def test_csv_files_as_they_are_written(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", twice', "1D"), (2, "two\nlines", "2F"), (3, "plain", "3D")], "k bigint, s string, code string")
    io.write_table(df, str(tmp_path / "t"), "csv")
    back = io.read_csv(spark, str(tmp_path / "t"))
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception):
        io.read_csv(spark, str(tmp_path / "ragged.csv"), infer_types=False).collect()


def brute_close(text):
    """Open brackets and strings of a text, one character after the other."""
    stack, quoted, skip = "", False, False
    for c in text:
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack += c
        elif c in "}]" and stack.endswith({"}": "{", "]": "["}[c]):
            stack = stack[:-1]
    return quoted, stack


def test_cut_json_is_closed(spark):
    whole = '{"a": [1, {"b": "x ] } \\" y", "c": []}], "d": {"e": null, "f": "é"}}'
    cuts = [whole[:n] for n in range(1, len(whole))]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(cuts)], "i int, t string").orderBy("i").select(close_truncated(F.col("t")).alias("c")).collect()]
    for cut, closed in zip(cuts, got):
        if not cut.endswith("\\"):
            assert brute_close(closed) == (False, ""), cut
    out = with_recovered_json(spark.createDataFrame([(t,) for t in cuts], "t string"), "t").select("t", F.to_json("json").alias("j")).collect()
    for r in out:
        if r.j is not None:
            json.loads(r.j)
    assert sum(r.j is not None for r in out) > len(cuts) // 2


def test_correlations_of_a_wide_table_take_one_scan(spark, tmp_path):
    import time

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    wide = pd.DataFrame(rng.normal(1e6, 1, (300, 150)), columns=[f"c{i}" for i in range(150)])
    wide["c1"], wide["c2"] = 3.0, -2 * wide["c0"]
    wide.loc[::7, "c5"] = np.nan
    spark.createDataFrame(wide).write.parquet(str(tmp_path / "w"))
    began = time.time()
    out = profile.corr_long(spark.read.parquet(str(tmp_path / "w")), list(wide.columns))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    got = {(r.col_a, r.col_b): r["corr"] for r in out.collect()}
    assert time.time() - began < 60 and len(got) == 150 * 149 // 2
    want = wide.corr()
    for (a, b), r in got.items():
        assert (r is None and np.isnan(want.loc[a, b])) or abs(r - want.loc[a, b]) < 1e-6


def test_numbers_are_strict_and_missing_values_stay_missing(spark):
    from sparkprep.operators.schema import cast_type
    from sparkprep.operators.text import normalize_text

    df = spark.createDataFrame([("12d", 1.5), ("3f", float("nan")), (" 4.5 ", None), ("1e3", 2.0), ("x", 0.0)], "s string, d double")
    got = [r.s for r in cast_type(df, ["s"], "float", errors="coerce").df.collect()]
    assert got == [None, None, 4.5, 1000.0, None]
    texts = [r.d for r in normalize_text(df, ["d"]).df.collect()]
    assert texts == ["1.5", None, None, "2.0", "0.0"]


def test_whole_rows_of_any_type_are_compared(spark):
    from pyspark.sql import functions as F

    from sparkprep.operators.rows import deduplicate

    df = spark.createDataFrame([(1, float("nan"), [1.0, None]), (1, float("nan"), [1.0, None]), (2, 0.5, []), (2, 0.5, None)], "i int, d double, a array<double>")
    df = df.withColumn("m", F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.col("i")))
    df = df.unionByName(df.where("i = 2 and a is not null").withColumn("m", F.create_map(F.lit("a"), F.col("i"), F.lit("b"), F.lit(1))))
    out = deduplicate(df).df.collect()
    assert sorted((r.i, str(r.d), str(r.a)) for r in out) == [(1, "nan", "[1.0, None]"), (2, "0.5", "None"), (2, "0.5", "[]")]
    assert [str(r.d) for r in out if r.i == 1] == ["nan"]
    assert {(r.i, r.a is None) for r in deduplicate(df, keep="none").df.collect()} == {(2, True)}
