import pytest

from sparkprep.operators import encode, features, impute, outliers, rows, schema, text


def test_fix_names_and_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`A b` int, `c-D` int")
    res = schema.fix_column_names(df)
    assert res.df.columns == ["a_b", "c_d"]
    clash = spark.createDataFrame([(1, 2)], "`A b` int, `a-b` int")
    with pytest.raises(ValueError):
        schema.fix_column_names(clash)
    assert schema.fix_column_names(clash, "suffix").df.columns == ["a_b", "a_b_2"]


def test_drop_column_protects_target(spark, toy):
    with pytest.raises(ValueError):
        schema.drop_column(toy, ["income"], target_column="income")
    res = schema.drop_column(toy, ["age", "zzz"], on_missing="skip")
    assert "age" not in res.df.columns and res.diff["missing"] == ["zzz"]


def test_cast_modes(spark):
    df = spark.createDataFrame([("1",), ("2.0",), ("2.5",), ("x",), (None,)], "s string")
    with pytest.raises(RuntimeError):
        schema.cast_type(df, ["s"], "int")
    co = schema.cast_type(df, ["s"], "int", "coerce")
    assert [r[0] for r in co.df.collect()] == [1, 2, None, None, None]
    assert co.diff["invalid_values_coerced"] == {"s": 2}
    ig = schema.cast_type(df, ["s"], "int", "ignore")
    assert ig.df.schema["s"].dataType.simpleString() == "string"
    fl = schema.cast_type(df, ["s"], "float", "coerce").df.collect()
    assert [r[0] for r in fl] == [1.0, 2.0, 2.5, None, None]


def test_schema_align(spark):
    df = spark.createDataFrame([(1, 2)], "y int, z int")
    out = schema.align_schema(df, ["x", "y"])
    assert out.columns == ["x", "y"] and out.first()["x"] == 0


def test_normalize_unicode_whitespace(spark):
    df = spark.createDataFrame([("\ta ",), ("a\u001cb",), ("Café",), ("ﬁ",), ("x²",)], "s string")
    out = text.normalize_text(df, ["s"], ops=["strip", "lower", "remove_accents", "collapse_whitespace"]).df
    assert [r[0] for r in out.collect()] == ["a", "a b", "cafe", "fi", "x2"]


def test_normalize_audit_counts(spark):
    df = spark.createDataFrame([(" A ",), ("b",), ("N/A",), (None,)], "s string")
    res = text.normalize_text(df, ["s"], null_like_to_nan=["n/a"], replace=[{"pattern": "b", "repl": "B"}])
    assert [r[0] for r in res.df.collect()] == ["a", "B", None, None]
    assert res.diff["values_changed_count"]["s"] == 2
    assert res.diff["null_like_converted_to_nan"]["s"] == 1
    assert res.diff["replacements_applied"]["s"] == 1
    # rules run before the null-like check, as in the reference
    r2 = text.normalize_text(df, ["s"], null_like_to_nan=["n/a"], replace=[{"pattern": "a", "repl": "z"}])
    assert [r[0] for r in r2.df.collect()] == ["z", "b", "n/z", None]


def test_dedup_variants(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "A", 20), (3, "b", 30), (4, None, 40), (5, None, 50)], "id int, k string, v int")
    first = rows.deduplicate(df, ["k"], "first", True, ["id"]).df
    assert sorted(r["id"] for r in first.collect()) == [1, 3, 4]
    last = rows.deduplicate(df, ["k"], "last", True, ["id"]).df
    assert sorted(r["id"] for r in last.collect()) == [2, 3, 5]
    none = rows.deduplicate(df, ["k"], "none", True).df
    assert [r["id"] for r in none.collect()] == [3]
    with pytest.raises(ValueError):
        rows.deduplicate(df, [], "first")
    res = rows.deduplicate(df, ["k"], "first", True, ["id"])
    assert res.diff["rows_removed"] == 2 and len(res.diff["duplicate_key_examples"]) == 2


def test_outliers_clip_never_fills_null(spark):
    vals = [(float(i),) for i in range(20)] + [(1000.0,), (None,)]
    df = spark.createDataFrame(vals, "x double")
    res = outliers.remove_outliers(df, ["x"], "iqr", mode="clip")
    got = [r[0] for r in res.df.collect()]
    assert got[-1] is None and max(v for v in got if v is not None) < 1000.0
    assert res.diff["values_clipped_count"] == {"x": 1}
    cst = spark.createDataFrame([(2.0,), (2.0,), (2.0,)], "x double")
    r2 = outliers.remove_outliers(cst, ["x"], "zscore")
    assert r2.df.count() == 3 and any("std=0" in w for w in r2.warnings)


def test_handle_missing_toy(spark, toy):
    res = impute.handle_missing(toy, ["age", "workclass"])
    ages = [r["age"] for r in res.df.collect()]
    assert ages[2] == pytest.approx((39 + 50 + 53 + 28 + 37) / 5)
    assert res.diff["imputation_values"]["age"] == "MICE_Estimated"


def test_handle_missing_all_missing(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    res = impute.handle_missing(df, ["x", "s"])
    assert [tuple(r) for r in res.df.collect()] == [(0.0, "MISSING"), (0.0, "MISSING")]


def _numpy_mice(X, max_iter=10, tol=1e-3):
    """Independent brute-force chained regression with a Bayesian ridge
    solved by SVD on the raw rows."""
    import numpy as np

    X = X.astype(float)
    mask = np.isnan(X)
    Xt = np.where(mask, np.nanmean(X, axis=0), X)
    order = np.argsort(mask.mean(axis=0), kind="mergesort")
    norm_tol = tol * np.max(np.abs(X[~mask]))
    prev = Xt.copy()
    for _ in range(max_iter):
        for j in order:
            if not mask[:, j].any():
                continue
            others = [i for i in range(X.shape[1]) if i != j]
            obs = ~mask[:, j]
            A = Xt[obs][:, others]
            y = Xt[obs, j]
            am, ym = A.mean(axis=0), y.mean()
            Ac, yc = A - am, y - ym
            n = len(y)
            U, S, Vh = np.linalg.svd(Ac, full_matrices=False)
            ev = S**2
            alpha, lam = 1.0 / (np.var(yc) + np.finfo(float).eps), 1.0
            coef_old = None
            for it in range(300):
                coef = Vh.T @ ((Vh @ (Ac.T @ yc)) / (ev + lam / alpha))
                rmse = np.sum((yc - Ac @ coef) ** 2)
                gamma = np.sum(alpha * ev / (lam + alpha * ev))
                lam = (gamma + 2e-6) / (np.sum(coef**2) + 2e-6)
                alpha = (n - gamma + 2e-6) / (rmse + 2e-6)
                if it != 0 and np.sum(np.abs(coef_old - coef)) < 1e-3:
                    break
                coef_old = coef.copy()
            coef = Vh.T @ ((Vh @ (Ac.T @ yc)) / (ev + lam / alpha))
            pred = ym + (Xt[mask[:, j]][:, others] - am) @ coef
            Xt[mask[:, j], j] = pred
        if np.max(np.sum(np.abs(Xt - prev), axis=1)) < norm_tol:
            break
        prev = Xt.copy()
    return Xt


def test_mice_matches_bruteforce(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    n = 200
    a = rng.normal(10, 2, n)
    b = 3 * a + rng.normal(0, 1, n)
    c = -a + 0.5 * b + rng.normal(0, 1, n)
    X = np.stack([a, b, c], axis=1)
    X[rng.random(n) < 0.2, 0] = np.nan
    X[rng.random(n) < 0.1, 1] = np.nan
    X[rng.random(n) < 0.3, 2] = np.nan
    rows_ = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(n)]
    df = spark.createDataFrame(rows_, "id int, a double, b double, c double")
    st = impute.fit_mice(df, ["a", "b", "c"])
    got = impute.apply_mice(df, st).orderBy("id").select("a", "b", "c").collect()
    want = _numpy_mice(X)
    assert np.allclose(np.array([tuple(r) for r in got]), want, rtol=1e-6, atol=1e-6)


def test_mice_scans_do_not_grow_with_rounds_or_columns(spark, monkeypatch):
    """All rounds come from the patterns' moments; a large offset costs no
    digits; the way through the rows gives the same regressions."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, d = 400, 5
    X = rng.normal(0, 1, (n, d)) @ rng.normal(0, 1, (d, d)) + np.array([0, 1e6, -5, 3, 100])
    holes = rng.random((n, d)) < 0.15
    X[holes] = np.nan
    X[0] = np.nan  # a row without any value
    cols = [f"c{i}" for i in range(d)]
    rows_ = [(i, *[None if np.isnan(v) else float(v) for v in X[i]]) for i in range(n)]
    df = spark.createDataFrame(rows_, "id int, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    scans = []
    first = type(df).first
    collect = type(df).collect
    monkeypatch.setattr(type(df), "first", lambda self: scans.append(1) or first(self))
    monkeypatch.setattr(type(df), "collect", lambda self: scans.append(1) or collect(self))
    states = [impute.fit_mice(df, cols, max_iter=m, tol=1e-12) for m in (2, 9)]
    assert [s["n_iter"] for s in states] == [2, 9]
    by_fit = len(scans) / 2
    assert by_fit <= 4  # first() collects: two jobs a fit
    rows_state = impute._fit_by_rows(df, cols, 2, 1e-12, 120)
    monkeypatch.undo()
    for a, b in zip(states[0]["steps"], rows_state["steps"], strict=True):
        assert (a["round"], a["feature"], a["others"]) == (b["round"], b["feature"], b["others"])
        assert np.allclose(a["coef"], b["coef"], rtol=1e-6, atol=1e-8)
    got = impute.apply_mice(df, states[1]).orderBy("id").select(*cols).collect()
    assert np.allclose(np.array([tuple(r) for r in got]), _numpy_mice(X, 9, 1e-12), rtol=1e-6, atol=1e-5)
    # more patterns than may be held: the rows' way, the same fills
    monkeypatch.setattr(impute, "PATTERN_DOUBLES", 25)
    other = impute.fit_mice(df, cols, max_iter=2, tol=1e-12)
    assert np.allclose(other["steps"][-1]["coef"], states[0]["steps"][-1]["coef"], rtol=1e-6, atol=1e-8)


def test_mice_of_empty_and_complete_tables(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert impute.fit_mice(empty, ["a", "b"])["steps"] == []
    full = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    assert impute.fit_mice(full, ["a", "b"])["steps"] == []
    assert impute.fit_mice(full, []) == {"columns": [], "means": [], "steps": [], "n_iter": 0}


def test_one_hot_eager_and_topk(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "c string")
    out = encode.one_hot(df, ["c"]).df
    assert out.columns == ["c__a", "c__b", "c__c"]
    assert tuple(out.collect()[-1]) == (None, None, None)
    top = encode.one_hot(df, ["c"], max_categories=1).df
    assert top.columns == ["c__OTHER", "c__b"]


def test_unseen_categories(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    apply = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    st = encode.fit_ordinal_stage(train, ["c"])
    codes = [r[0] for r in encode.apply_ordinal_stage(apply, st).collect()]
    assert codes == [0.0, -1.0, -1.0]
    oh = encode.apply_one_hot_stage(apply, encode.fit_one_hot_stage(train, ["c"]))
    assert [tuple(r) for r in oh.collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    rare = features.fit_group_rare(train, min_frequency_abs=1, min_frequency_pct=0.0)
    assert [r[0] for r in features.apply_group_rare(apply, rare).collect()] == ["a", "Other", None]


def test_skew_negative_min(spark):
    vals = [(-1.0,)] + [(float(i) ** 3,) for i in range(30)]
    df = spark.createDataFrame(vals, "x double")
    assert features.fit_skewed(df, columns=["x"])["transforms"] == {}
    yj = features.fit_skewed(df, columns=["x"], method="yeo-johnson")["transforms"]
    assert "x" in yj and -5 < yj["x"]["lambda"] < 5


def test_yeo_johnson_lambda_is_mle(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.lognormal(0, 0.8, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    lam = features.fit_yeo_johnson_lambda(df, ["x"])["x"]

    def ll(l):
        t = np.log1p(x) if abs(l) < 1e-12 else ((x + 1) ** l - 1) / l
        return -len(x) / 2 * np.log(t.var()) + (l - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

    grid = np.linspace(-3, 3, 60001)
    best = grid[np.argmax([ll(g) for g in grid])]
    assert abs(lam - best) < 1e-3


def test_scale_zero_std(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "x double, y double")
    st = features.fit_scale(df)
    out = features.apply_scale(df, st).collect()
    assert [r["x"] for r in out] == [0.0, 0.0] and [r["y"] for r in out] == [-1.0, 1.0]


def test_bins_uniform_and_indicators(spark):
    df = spark.createDataFrame([(float(i), None if i % 4 == 0 else i) for i in range(10)], "x double, m int")
    st = features.fit_bin_numeric(df, ["x"], 5, "uniform")
    assert [r["x__bin"] for r in features.apply_bin_numeric(df, st).collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    ind = features.fit_missing_indicators(df)
    assert ind["indicator_cols"] == ["m_was_missing"]
    drift = spark.createDataFrame([(1.0,)], "x double")
    assert features.apply_missing_indicators(drift, ind).first()["m_was_missing"] == 0


def test_indicator_kept_when_source_absent(spark):
    df = spark.createDataFrame([(1, 1), (2, 0)], "k int, m_was_missing int")
    out = features.apply_missing_indicators(df, {"indicator_cols": ["m_was_missing"]})
    assert [tuple(r) for r in out.orderBy("k").collect()] == [(1, 1), (2, 0)]


def _lloyd_brute(x, k, max_iter=300, tol=1e-4):
    import numpy as np

    edges = np.linspace(x.min(), x.max(), k + 1)
    centers, tol = (edges[1:] + edges[:-1]) / 2, tol * x.var()
    for _ in range(max_iter):
        label = np.searchsorted((centers[1:] + centers[:-1]) / 2, x, side="left")
        new = np.array([x[label == i].mean() if (label == i).any() else centers[i] for i in range(k)])
        shift = ((new - centers) ** 2).sum()
        centers = np.sort(new)
        if shift <= tol:
            break
    return [x.min(), *((centers[1:] + centers[:-1]) / 2), x.max()]


def test_kmeans_bins_match_bruteforce(spark, monkeypatch):
    """Cells give the row-wise iterations' centres, however coarse the cells,
    with a value that holds a third of the rows and an empty bin."""
    import numpy as np

    from sparkprep.operators import features as fe

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.lognormal(0, 1.5, 1200), np.full(700, 2.5), [500.0], rng.normal(40, 3, 200)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    want = {k: _lloyd_brute(x, k) for k in (2, 5, 8)}
    for cells, sub in ((4096, 64), (7, 3)):
        monkeypatch.setattr(fe, "CELLS", cells)
        monkeypatch.setattr(fe, "SUBCELLS", sub)
        for k in (2, 5, 8):
            assert np.allclose(fe._kmeans_1d(df, "x", k, float(x.min()), float(x.max())), want[k], rtol=1e-9)
    assert fe._kmeans_1d(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 3, 3.0, 3.0) == [3.0] * 4


def test_yeo_johnson_lambda_is_the_likelihoods_maximum(spark):
    """Against a fine search in numpy: negative values, a lambda beyond the
    first grid, one near zero, a constant column."""
    import numpy as np

    from sparkprep.operators import features as fe

    rng = np.random.default_rng(9)
    cols = {
        "a": rng.lognormal(0, 1, 600) - 0.5,
        "b": -rng.lognormal(0, 0.8, 600),
        "c": np.expm1(rng.normal(3, 0.5, 600)),
        "d": 1 - rng.exponential(0.02, 600).clip(0, 0.9),
        "e": np.full(600, 4.0),
    }

    def ll(x, lam):
        u = np.log1p(np.abs(x))
        p = np.where(x >= 0, lam, 2 - lam)
        g = np.where(np.abs(p) < 1e-9, u, np.expm1(p * u) / np.where(np.abs(p) < 1e-9, 1, p))
        t = np.where(x >= 0, g, -g)
        if not 1e-300 < t.var() < np.inf:  # a power so far off that all values are one
            return -np.inf
        return -len(x) / 2 * np.log(t.var()) + (lam - 1) * (np.sign(x) * u).sum()

    df = spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*cols.values())], ", ".join(f"{c} double" for c in cols))
    got = fe.fit_yeo_johnson_lambda(df, list(cols))
    for c in "abcd":
        lo, hi = -100.0, 100.0
        for _ in range(12):
            at = np.linspace(lo, hi, 41)
            k = int(np.argmax([ll(cols[c], v) for v in at]))
            lo, hi = at[max(k - 1, 0)], at[min(k + 1, 40)]
        assert abs(got[c] - (lo + hi) / 2) < 1e-4, (c, got[c], lo)
    assert got["e"] == 1.0 and got["d"] > 5
