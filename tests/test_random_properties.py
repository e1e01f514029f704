"""Randomised checks of the exact quantile paths and deduplication against
numpy / pandas brute force (few examples each: every example runs Spark
jobs)."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sparkprep.operators import profile as P
from sparkprep.operators import rows as R

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

values = st.lists(
    st.one_of(st.none(), st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False, width=32).map(float)),
    min_size=1,
    max_size=300,
)
probs = st.lists(st.sampled_from([0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]), min_size=1, max_size=4, unique=True)


@SETTINGS
@given(vals=values, ps=probs, heavy=st.integers(0, 200))
def test_quantile_paths_match_numpy(spark, vals, ps, heavy):
    vals = vals + [3.5] * heavy  # optional heavy value
    clean = np.array([v for v in vals if v is not None], dtype=float)
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(3)
    want = np.quantile(clean, ps).tolist() if len(clean) else [None] * len(ps)
    direct = P.quantiles(df, ["x"], ps)["x"]
    bracket = P.quantiles(df, ["x"], ps, hold=1)["x"]
    dv = P.value_counts_long(df).select("column", "num", "cnt")
    bucket = {r["p_index"]: r["value"] for r in P.quantiles_from_counts(dv, ps, hold=1).collect()}
    bucket = [bucket.get(i) for i in range(len(ps))]
    for got in (direct, bracket, bucket):
        if len(clean) == 0:
            assert all(g is None for g in got)
        else:
            assert np.allclose(got, want, rtol=1e-12, atol=1e-9)


rows_st = st.lists(st.tuples(st.integers(0, 6), st.one_of(st.none(), st.sampled_from(["a", "A", "b", "B", "c"]))), min_size=1, max_size=60)


@SETTINGS
@given(rows=rows_st, keep=st.sampled_from(["first", "last", "none"]), ci=st.booleans())
def test_dedup_matches_pandas(spark, rows, keep, ci):
    pdf = pd.DataFrame([(i, k, s) for i, (k, s) in enumerate(rows)], columns=["id", "k", "s"])
    df = spark.createDataFrame(pdf, "id long, k long, s string").repartition(3)
    cmp = pdf.assign(s=pdf["s"].str.lower()) if ci else pdf
    mask = cmp.duplicated(subset=["k", "s"], keep=False if keep == "none" else keep)
    want = sorted(pdf.loc[~mask, "id"].tolist())
    got = sorted(r["id"] for r in R.deduplicate(df, ["k", "s"], keep, ci, order_by=["id"]).df.collect())
    assert got == want
