import math


from sparkprep.operators import profile as P


def test_missing_contract_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    row = P.profile(df).first()
    assert row["missing_count"] == 2 and row["n_unique"] == 1 and row["is_constant"]


def test_profile_toy(spark, toy):
    rows = {r["column"]: r for r in P.profile(toy).collect()}
    assert rows["age"]["missing_count"] == 1
    assert rows["age"]["num_median"] == 39.0
    assert rows["age"]["num_mean"] == round((39 + 50 + 53 + 28 + 37) / 5, 6)
    assert rows["education"]["n_unique"] == 4
    assert rows["education"]["sample_values"] == ["11th", "Bachelors", "HS-grad", "Masters"]
    assert rows["workclass"]["is_text_like"] and not rows["workclass"]["is_numeric"]


def test_profile_dict_target(spark, toy):
    d = P.profile_dict(toy, "income")
    assert d["n_rows"] == 6 and d["n_cols"] == 5
    assert d["target_profile"]["class_counts"] == {"<=50K": 4, ">50K": 2}


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), (None,)], "c string")
    m = P.modes(P.value_counts_long(df)).first()
    assert m["mode"] == "a" and m["mode_count"] == 2


def test_quantiles_match_linear_interpolation(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),)], "x double")
    exact = P.quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]
    bucketed = P.quantiles(df, ["x"], [0.25, 0.5, 0.75], hold=1)["x"]
    assert exact == [1.75, 2.5, 4.75] == bucketed


def test_quantiles_bucketed_with_heavy_value(spark):
    # one value holds a third of all rows; both exact paths agree with numpy
    import numpy as np

    vals = [5.0] * 300 + [float(i) for i in range(600)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    probs = [0.1, 0.33, 0.5, 0.9]
    want = np.quantile(np.array(vals), probs).tolist()
    got = P.quantiles(df, ["x"], probs, hold=1)["x"]
    assert all(math.isclose(a, b) for a, b in zip(got, want))


def test_constant_column_corr_is_null(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 2.0), (2.0, 3.0)], "x double, y double")
    r = P.corr_long(df, ["x", "y"]).first()
    assert r["corr"] is None


def test_overview_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None)], "k int, s string")
    r = P.overview(df).first()
    assert (r["rows"], r["duplicate_rows"], r["total_missing"], r["categorical_columns"]) == (4, 2, 2, 1)


def test_empty_table_schema(spark):
    df = spark.createDataFrame([], "x double, s string")
    rows = P.profile(df).collect()
    assert [r["missing_count"] for r in rows] == [0, 0]
    assert P.overview(df).first()["rows"] == 0


def test_partition_count_invariance(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    a = sorted(P.describe(df.repartition(1)).collect())
    b = sorted(P.describe(df.repartition(7)).collect())
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and math.isclose(u, v, rel_tol=1e-9))


def test_compare_sections(spark, toy):
    after = toy.dropna().drop("hours_per_week")
    rows = P.compare(toy, after).collect()
    d = {(r["section"], r["name"]): (r["before"], r["after"]) for r in rows}
    assert d[("dataset", "rows")] == (6, 5)
    assert d[("schema", "hours_per_week")] == (1, 0)
    assert d[("missing_by_column", "age")] == (1, 0)


def test_column_types_approx_close_to_exact(spark):
    from sparkprep.sources.tables import dirty

    d = dirty(spark, "/root/testdata/sf0.001", "dirty_orders")
    exact = {r["column"]: r for r in P.column_types(d).collect()}
    rsd = 0.02
    approx = {r["column"]: r for r in P.column_types(d, approx=True, rsd=rsd).collect()}
    for c, r in exact.items():
        assert approx[c]["missing"] == r["missing"] and approx[c]["missing_pct"] == r["missing_pct"]
        # within three standard deviations of the configured accuracy
        assert abs(approx[c]["n_unique"] - r["n_unique"]) <= max(2, 3 * rsd * r["n_unique"])


def test_profiles_of_every_column_type(spark):
    """Decimals keep their digits; NaN is missing inside arrays; maps compare
    as sets of entries; nested timestamps to the microsecond; bytes count."""
    df = spark.sql(
        """SELECT * FROM VALUES
        (CAST(9007199254740992 AS DECIMAL(20,0)), array(1.0D, double('NaN')), map('a', 1, 'b', 2), X'00FF', named_struct('t', TIMESTAMP'2020-01-01 00:00:00.000001', 'n', CAST(NULL AS INT)), -0.0D),
        (CAST(9007199254740993 AS DECIMAL(20,0)), array(1.0D, CAST(NULL AS DOUBLE)), map('b', 2, 'a', 1), X'00FE', named_struct('t', TIMESTAMP'2020-01-01 00:00:00.000002', 'n', CAST(NULL AS INT)), 0.0D),
        (NULL, NULL, NULL, NULL, NULL, double('NaN')) AS t(d, a, m, b, s, z)"""
    )
    got = {r["column"]: (r["missing_count"], r["n_unique"], r["is_constant"]) for r in P.profile(df).collect()}
    assert got == {"d": (1, 2, False), "a": (1, 1, True), "m": (1, 1, True), "b": (1, 2, False), "s": (1, 2, False), "z": (1, 1, True)}
    samples = {r["column"]: r["sample_values"] for r in P.profile(df).collect()}
    assert samples["d"] == ["9007199254740992", "9007199254740993"] and samples["b"] == ["00FE", "00FF"]
    near = {r["column"]: (r["missing_count"], r["n_unique"]) for r in P.profile(df, approx=True).collect()}
    assert near == {c: v[:2] for c, v in got.items()}
    types = {r["column"]: (r["missing"], r["n_unique"]) for r in P.column_types(df).collect()}
    assert types == near and types == {r["column"]: (r["missing"], r["n_unique"]) for r in P.column_types(df, approx=True).collect()}
    assert {r["column"]: r["count"] for r in P.describe(df).collect()} == dict.fromkeys("dambsz", 2)
    o = P.overview(df.select("a", "m", "z")).first()
    assert (o["rows"], o["duplicate_rows"], o["total_missing"]) == (3, 1, 3)
    from sparkprep.operators import quality

    flags = {r["column"]: r["is_constant"] for r in quality.constant_columns(df).collect()}
    assert flags == {c: v[2] for c, v in got.items()}
