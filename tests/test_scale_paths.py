"""The scale-oriented code paths agree with simple single-task versions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkprep.operators import encode
from sparkprep.operators.profile import dense_codes, value_counts_long


def test_dense_codes_match_window_rank(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
        F.col("o_totalprice").cast("string").alias("a"), "o_orderpriority", "o_orderstatus"
    )
    vc = value_counts_long(o)
    for order in ([F.asc("value")], [F.desc("cnt"), F.asc("value")]):
        got = dense_codes(vc, order, partitions=5).select("column", "value", "code")
        want = vc.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy(*order)) - 1)
        assert got.exceptAll(want.select("column", "value", "code")).count() == 0
        assert got.count() == vc.count()


def test_large_vocabulary_uses_code_table(spark):
    df = spark.range(0, 1500).select(F.format_string("v%05d", "id").alias("c"))
    st = encode.fit_ordinal(df, ["c"])
    assert isinstance(st["c"], tuple)
    out = encode.apply_ordinal(df, st).orderBy("c__ord").collect()
    assert [r["c__ord"] for r in out] == list(range(1500))


def test_streaming_matches_batch(spark, tmp_path):
    from sparkprep.plans.cleaner import PlanCleaner
    from sparkprep.plans.spec import Action, Plan
    from sparkprep.streaming.apply import run_to_table

    sf = "/root/testdata/sf0.001"
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value")
    plan = Plan(actions=[Action("clip_outliers", params={"columns": ["value"]}),
                         Action("encode_categorical", params={"method": "one_hot", "columns": ["event_type"]})])
    model = PlanCleaner(plan).fit(ev)
    stream = (spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema)
              .option("pathGlobFilter", "events.parquet").parquet(sf).select("event_id", "event_type", "value"))
    got = run_to_table(model.transform(stream), str(tmp_path / "run"))
    want = model.transform(ev)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_cast_plan_is_decided_at_fit_and_runs_on_a_stream(spark, tmp_path):
    """``ignore`` keeps what it decided at fit, whatever comes later; a stream
    goes through the plan; ``raise`` fails on a bad value of a later table."""
    import pytest

    from sparkprep.plans.cleaner import PlanCleaner, PlanModel
    from sparkprep.plans.spec import Action, Plan
    from sparkprep.streaming.apply import run_to_table

    def table(rows):
        return spark.createDataFrame(rows, "a string, b string, c string")

    def plan(errors):
        return Plan(actions=[Action("cast_type", params={"columns": ["a", "b"], "dtype": "int", "errors": errors}),
                             Action("cast_type", params={"columns": ["c"], "dtype": "float", "errors": "coerce"})])

    model = PlanCleaner(plan("ignore")).fit(table([("1", "x", "0.5"), ("2", "3", "?")]))
    model.save(str(tmp_path / "model"))
    later = table([("7", "8", "1.5"), ("bad", "9", None)])
    later.write.parquet(str(tmp_path / "in"))
    for m in (model, PlanModel.load(spark, str(tmp_path / "model"))):
        out = m.transform(later)
        assert out.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]
        assert sorted(map(tuple, out.collect()), key=str) == [(7, "8", 1.5), (None, "9", None)]
    stream = spark.readStream.schema(later.schema).parquet(str(tmp_path / "in"))
    got = run_to_table(model.transform(stream), str(tmp_path / "run"))
    assert sorted(map(tuple, got.collect()), key=str) == [(7, "8", 1.5), (None, "9", None)]
    with pytest.raises(RuntimeError, match="cannot be cast"):
        PlanCleaner(plan("raise")).fit(later)
    strict = PlanCleaner(plan("raise")).fit(table([("1", "2", "3")]))
    assert [tuple(r) for r in strict.transform(table([("4", None, "x")])).collect()] == [(4, None, None)]
    with pytest.raises(Exception, match="cannot be cast to int: bad"):
        strict.transform(later).collect()


def test_selection_is_bit_equal_for_any_partitioning_and_hold(spark, monkeypatch):
    import numpy as np

    from sparkprep.operators import profile as P
    from sparkprep.operators import quantiles as Q

    rng = np.random.default_rng(11)
    vals = np.concatenate([np.full(3000, 7.25), rng.normal(0, 5, 6000).round(3), [-0.0, 0.0, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    rounds = []
    count = Q.RawRows.count
    monkeypatch.setattr(Q.RawRows, "count", lambda self, *a: rounds.append(1) or count(self, *a))
    # a coarse sketch and a tiny last aggregate: several rounds
    runs = [P.quantiles(df.repartition(n), ["x"], probs, hold=h, accuracy=a)["x"] for n, h, a in [(1, 200_000, 10000), (5, 1, 100), (13, 40, 40)]]
    assert runs[0] == runs[1] == runs[2]
    assert len(rounds) >= 4
    assert runs[0][0] == -np.inf and runs[0][-1] == np.inf
    assert np.allclose(runs[0][1:-1], np.quantile(vals, probs[1:-1]), rtol=0, atol=1e-9)
    dv = P.value_counts_long(df).select("column", "num", "cnt").repartition(3)
    for hold in (1, 50, 200_000):
        got = {r["p_index"]: r["value"] for r in P.quantiles_from_counts(dv, probs, hold=hold).collect()}
        assert [got[i] for i in range(len(probs))] == runs[0]


def test_selection_of_many_columns_and_columns_without_values(spark):
    import numpy as np

    from sparkprep.operators import profile as P

    df = spark.range(2000).select(
        F.when(F.col("id") % 3 != 0, F.col("id") * 1.5).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(4).alias("c"), F.lit(float("nan")).alias("d")
    )
    a = np.array([i * 1.5 for i in range(2000) if i % 3])
    for hold in (1, 200_000):
        got = P.quantiles(df, ["a", "b", "c", "d"], [0.1, 0.9], hold=hold)
        assert np.allclose(got["a"], np.quantile(a, [0.1, 0.9])) and got["c"] == [4.0, 4.0]
        assert got["b"] == got["d"] == [None, None]
    assert P.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_bucket_path_with_heavy_value(spark):
    import numpy as np

    from sparkprep.operators import profile as P

    vals = [5.0] * 300 + [float(i) for i in range(600)]
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    dv = P.value_counts_long(df).select("column", "num", "cnt")
    probs = [0.1, 0.33, 0.5, 0.9]
    got = {r["p_index"]: r["value"] for r in P.quantiles_from_counts(dv, probs, hold=1).collect()}
    assert np.allclose([got[i] for i in range(len(probs))], np.quantile(np.array(vals), probs))


def test_hot_key_results_match_pandas(spark):
    """One key holds a third of all rows: dedup, value counts and overview
    stay exact (brute force in pandas)."""
    import pandas as pd

    rows = [(0 if i % 3 == 0 else i, i % 7, f"s{i % 5}") for i in range(3000)]
    pdf = pd.DataFrame(rows, columns=["k", "o", "s"])
    df = spark.createDataFrame(pdf).repartition(6)

    from sparkprep.operators import profile as P
    from sparkprep.operators import rows as R

    first = R.deduplicate(df, ["k"], "first", order_by=["o"]).df.toPandas().sort_values("k").reset_index(drop=True)
    want = pdf.sort_values(["k", "o", "s"]).drop_duplicates("k", keep="first").sort_values("k").reset_index(drop=True)
    assert first[["k", "o", "s"]].values.tolist() == want[["k", "o", "s"]].values.tolist()

    none = R.deduplicate(df, ["k"], "none").df.count()
    assert none == int((pdf.groupby("k").size() == 1).sum())

    vc = {(r["column"], r["value"]): r["cnt"] for r in P.value_counts_long(df, ["k"]).collect()}
    assert vc[("k", "0")] == 1000

    ov = P.overview(df.select("o", "s")).first()
    assert ov["duplicate_rows"] == int(pdf[["o", "s"]].duplicated().sum())


def test_correlation_with_an_outlier_whose_partner_is_missing(spark):
    from pyspark.sql import functions as F

    from sparkprep.operators.profile import corr_long

    base = spark.range(2000).select((F.hash("id") % 1000 / 997.0).alias("x"))
    df = base.select("x", (2 * F.col("x") + 0.5).alias("y"), F.lit(0.1).alias("c")).unionByName(spark.createDataFrame([(-1e9, None, 0.1)], "x double, y double, c double"))
    got = {(r.col_a, r.col_b): r["corr"] for r in corr_long(df.repartition(5), ["x", "y", "c"]).collect()}
    assert abs(got["x", "y"] - 1.0) < 1e-12 and got["x", "c"] is None and got["y", "c"] is None


def test_correlation_keeps_digits_beside_large_offsets(spark):
    from pyspark.sql import functions as F

    from sparkprep.operators.profile import corr_long

    df = spark.range(5000).select((F.hash("id") % 1000 / 997.0).alias("x"), (F.hash("id", F.lit(1)) % 1000 / 991.0).alias("e"))
    df = df.select("x", (F.col("x") + F.col("e")).alias("y"))
    plain = df.agg(F.corr("x", "y")).first()[0]
    far = df.select((F.col("x") + 1e6).alias("x"), (F.col("y") - 1e6).alias("y"))
    want = far.agg(F.corr("x", "y")).first()[0]
    got = corr_long(far, ["x", "y"]).first()["corr"]
    assert abs(got - plain) < 1e-9 and abs(got - want) < 1e-9
    some = df.select(F.when(F.hash("y") % 3 != 0, F.col("x")).alias("x"), F.when(F.hash("x") % 4 != 0, F.col("y")).alias("y"), F.lit(None).cast("double").alias("z"))
    rows = {(r.col_a, r.col_b): r["corr"] for r in corr_long(some, ["x", "y", "z"]).collect()}
    assert abs(rows["x", "y"] - some.dropna(subset=["x", "y"]).agg(F.corr("x", "y")).first()[0]) < 1e-12 and rows["x", "z"] is None
