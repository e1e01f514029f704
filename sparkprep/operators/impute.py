"""Missing-value imputation.

Numeric: median / mean / constant, or chained regression (MICE) with the
same schedule as an iterative imputer with a Bayesian-ridge estimator:
mean initial fill, features visited in ascending order of missing fraction,
at most ``max_iter`` rounds, early stop when the largest per-row change
``max_i sum_j |x_ij - prev_ij|`` falls below ``tol * max|observed|``.

Each regression needs only sufficient statistics, and filled values are
affine in the observed ones. So one scan groups the rows by missing pattern
and keeps counts, means and cross products, from which all rounds are solved
on the driver (``d x d`` problems); a second scan finds the round to stop
after. Both read the ``d`` participating columns only; nothing row-level
leaves the executors.

Categorical: most frequent value as a string (ties -> smallest) or a
constant, cast back to the column type.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.missing import field_type, is_bool, is_missing, is_numeric, missing_safe, qcol
from sparkprep.operators.base import Result, eager
from sparkprep.operators.heavy import top_counts
from sparkprep.operators.profile import quantiles

# ----------------------------------------------------------- categorical
def fit_mode(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-missing value per column (string, ties -> smallest),
    by heavy hitters: only nearly unique columns have all values counted."""
    if not columns:
        return {}
    found = {r["column"]: r["value"] for r in top_counts(df, columns).collect()}
    return {c: found.get(c) for c in columns}


def fill_values(df: DataFrame, fills: dict) -> DataFrame:
    """Replace missing cells with the given value, cast to the column type."""
    def fill(c):
        v = fills[c]
        return F.when(is_missing(df, c), F.lit(v).cast(field_type(df, c))).otherwise(qcol(c)).alias(c)

    return df.select(*[fill(c) if c in fills and fills[c] is not None else qcol(c) for c in df.columns])


# ------------------------------------------------------------- numeric
def fit_numeric_simple(df: DataFrame, columns: Sequence[str], strategy: str, constant=0) -> dict:
    if strategy == "median":
        q = quantiles(df, list(columns), [0.5])
        return {c: q[c][0] for c in columns}
    if strategy == "mean":
        row = df.agg(*[F.avg(missing_safe(df, c)).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    if strategy == "constant":
        return {c: constant for c in columns}
    raise ValueError(f"unknown numeric imputation strategy '{strategy}'")


def _bayesian_ridge(G: np.ndarray, xty: np.ndarray, yty: float, n: int, max_iter: int = 300, tol: float = 1e-3):
    """Bayesian ridge on centred sufficient statistics: ``G = Xc'Xc``,
    ``xty = Xc'yc``, ``yty = yc'yc``. Returns the coefficients."""
    d = G.shape[0]
    eps = np.finfo(np.float64).eps
    alpha = 1.0 / (yty / n + eps)
    lam = 1.0
    a1 = a2 = l1 = l2 = 1e-6
    ev, V = np.linalg.eigh(G)
    ev = np.clip(ev, 0.0, None)
    Vt_xty = V.T @ xty

    def update(alpha, lam):
        coef = V @ (Vt_xty / (ev + lam / alpha))
        rmse = yty - 2 * coef @ xty + coef @ G @ coef
        return coef, max(rmse, 0.0)

    coef_old = None
    for it in range(max_iter):
        coef, rmse = update(alpha, lam)
        gamma = np.sum((alpha * ev) / (lam + alpha * ev))
        lam = (gamma + 2 * l1) / (np.sum(coef**2) + 2 * l2)
        alpha = (n - gamma + 2 * a1) / (rmse + 2 * a2)
        if it != 0 and np.sum(np.abs(coef_old - coef)) < tol:
            break
        coef_old = coef.copy()
    coef, _ = update(alpha, lam)
    return coef if d else np.zeros(0)


def _step_stats(cur: DataFrame, cols: list[str], j: int | None, miss: dict[str, Column]):
    """Means and population covariances of all columns over the rows where
    feature ``j`` is observed (all rows for ``j=None``): one aggregate."""
    d = len(cols)
    src = cur if j is None else cur.filter(~miss[cols[j]])
    x = [F.col(f"__x{i}") for i in range(d)]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(x[i]).alias(f"m{i}") for i in range(d)]
    aggs += [F.covar_pop(x[i], x[k]).alias(f"c{i}_{k}") for i in range(d) for k in range(i, d)]
    row = src.agg(*aggs).first()
    n = int(row["n"])
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(d)])
    C = np.zeros((d, d))
    for i in range(d):
        for k in range(i, d):
            C[i, k] = C[k, i] = row[f"c{i}_{k}"] or 0.0
    return n, mean, C * n


def _regress(n, mean, S, j):
    d = len(mean)
    others = [i for i in range(d) if i != j]
    G = S[np.ix_(others, others)]
    xty = S[others, j]
    yty = S[j, j]
    coef = _bayesian_ridge(G, xty, yty, n)
    intercept = mean[j] - (mean[others] @ coef if others else 0.0)
    return others, coef, intercept


# Doubles of all patterns' cross products that the driver may hold (32 MB);
# beyond it the regressions are aggregated from the rows, with equal results.
PATTERN_DOUBLES = 4_000_000


class _Patterns:
    """Rows grouped by which of ``d`` columns are missing: counts, means and
    centred cross products of the observed ones.

    A filled value is an affine function of the row's observed values, the
    same function for all rows of a pattern. So the moments of the filled
    table after any number of regressions follow from these arrays
    (``fill @ observed + shift``), without the rows.
    """

    def __init__(self, rows, d: int):
        rows = sorted(rows, key=lambda r: r["pattern"])  # sums in one order, however they arrive
        self.missing = np.array([[ch == "1" for ch in r["pattern"]] for r in rows], dtype=bool).reshape(len(rows), d)
        self.n = np.array([r["n"] for r in rows], dtype=float)
        self.mean = np.array([[r[f"m{i}"] or 0.0 for i in range(d)] for r in rows]).reshape(len(rows), d)
        self.cross = np.zeros((len(rows), d, d))
        for i in range(d):
            for k in range(i, d):
                self.cross[:, i, k] = self.cross[:, k, i] = [(r[f"c{i}_{k}"] or 0.0) * r["n"] for r in rows]
        self.largest = max((r[f"a{i}"] for r in rows for i in range(d) if r[f"a{i}"] is not None), default=0.0)

    def column_means(self) -> list[float | None]:
        n = (self.n[:, None] * ~self.missing).sum(axis=0)
        total = (self.n[:, None] * self.mean).sum(axis=0)
        return [float(t / k) if k else None for t, k in zip(total, n)]

    def missing_counts(self) -> list[int]:
        return [int(x) for x in (self.n[:, None] * self.missing).sum(axis=0)]

    def start(self, means) -> None:
        d = self.missing.shape[1]
        self.fill = np.where(self.missing[:, :, None], 0.0, np.eye(d)[None])
        self.shift = np.where(self.missing, np.array(means, dtype=float)[None], 0.0)

    def moments(self, j: int):
        """Rows, means and cross products of the filled columns where ``j``
        is observed."""
        use = ~self.missing[:, j]
        n, fill = self.n[use], self.fill[use]
        centre = np.einsum("pik,pk->pi", fill, self.mean[use]) + self.shift[use]
        total = n.sum()
        mean = (n[:, None] * centre).sum(axis=0) / total
        off = centre - mean
        S = np.einsum("pik,pkl,pjl->ij", fill, self.cross[use], fill, optimize=True)
        return int(total), mean, S + np.einsum("p,pi,pj->ij", n, off, off)

    def regress(self, j: int, others, coef, intercept: float) -> None:
        """Fill column ``j`` by a regression, where it is missing."""
        at = self.missing[:, j]
        self.fill[at, j] = np.einsum("i,pik->pk", coef, self.fill[at][:, others])
        self.shift[at, j] = intercept + self.shift[at][:, others] @ coef


def _patterns(df: DataFrame, cols: list[str]) -> _Patterns | None:
    """One scan; ``None`` if there are too many patterns for the driver."""
    d = len(cols)
    x = [missing_safe(df, c).cast("double") for c in cols]
    narrow = df.select(
        F.concat(*[F.when(is_missing(df, c), "1").otherwise("0") for c in cols]).alias("pattern"), *[x[i].alias(f"x{i}") for i in range(d)]
    )
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(f"x{i}").alias(f"m{i}") for i in range(d)]
    aggs += [F.max(F.abs(f"x{i}")).alias(f"a{i}") for i in range(d)]
    aggs += [F.covar_pop(f"x{i}", f"x{k}").alias(f"c{i}_{k}") for i in range(d) for k in range(i, d)]
    most = max(1, PATTERN_DOUBLES // (d * d))
    rows = narrow.groupBy("pattern").agg(*aggs).limit(most + 1).collect()
    return _Patterns(rows, d) if len(rows) <= most else None


def _changes(df: DataFrame, cols: list[str], means, steps: list[dict], rounds: int) -> list[float]:
    """Largest change of a row in each round, ``max_i sum_j |x_ij - prev_ij|``:
    one scan replays all rounds, a batch of rows at a time, and each task
    returns one row."""
    d = len(cols)
    narrow = df.select(*[missing_safe(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    first = np.array(means, dtype=float)
    plan = [(st["round"] - 1, st["feature"], st["others"], np.array(st["coef"]), st["intercept"]) for st in steps]

    def task(batches):
        most = np.zeros(rounds)
        for batch in batches:
            if not batch.num_rows:
                continue
            X = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)], axis=1)
            missing = np.isnan(X)
            some = missing.any(axis=1)
            X, missing = X[some], missing[some]
            X = np.where(missing, first, X)
            rows = [np.flatnonzero(missing[:, j]) for j in range(d)]
            before, now = X.copy(), 0
            for r, j, others, coef, intercept in plan:
                if r != now:
                    most[now] = max(most[now], np.abs(X - before).sum(axis=1).max(initial=0.0))
                    before, now = X.copy(), r
                X[rows[j], j] = intercept + X[rows[j]][:, others] @ coef
            most[now] = max(most[now], np.abs(X - before).sum(axis=1).max(initial=0.0))
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in most], names=[f"r{r}" for r in range(rounds)])

    per_task = narrow.mapInArrow(task, ", ".join(f"r{r} double" for r in range(rounds)))
    row = per_task.agg(*[F.max(f"r{r}").alias(f"r{r}") for r in range(rounds)]).first()
    return [row[f"r{r}"] or 0.0 for r in range(rounds)]


def fit_mice(df: DataFrame, columns: Sequence[str], max_iter: int = 10, tol: float = 1e-3, lineage_limit: int = 120) -> dict:
    """Fit chained regressions; the state replays on any table.

    Two scans, whatever the number of rounds and columns: the moments of each
    missing pattern, from which all rounds are solved on the driver
    (:class:`_Patterns`), and the rows' changes by round, which tell the round
    to stop after. Only if the patterns are too many for the driver are the
    regressions aggregated from the rows (:func:`_fit_by_rows`).
    """
    cols = list(columns)
    d = len(cols)
    patterns = _patterns(df, cols) if d else None
    if d and patterns is None:
        return _fit_by_rows(df, cols, max_iter, tol, lineage_limit)
    means = patterns.column_means() if d else []
    nmiss = patterns.missing_counts() if d else []
    state = {"columns": cols, "means": means, "steps": [], "n_iter": 0}
    if d <= 1 or max_iter < 1 or all(m == 0 for m in nmiss) or any(m is None for m in means):
        return state
    order = sorted(range(d), key=lambda i: (nmiss[i], i))
    patterns.start(means)
    steps = []
    for rnd in range(1, max_iter + 1):
        for j in order:
            others, coef, intercept = _regress(*patterns.moments(j), j)
            steps.append({"round": rnd, "feature": j, "others": others, "coef": coef.tolist(), "intercept": float(intercept)})
            patterns.regress(j, others, coef, float(intercept))
    changes = _changes(df, cols, means, steps, max_iter)
    norm_tol = tol * patterns.largest
    state["n_iter"] = next((r for r, change in enumerate(changes, 1) if change < norm_tol), max_iter)
    state["steps"] = [st for st in steps if st["round"] <= state["n_iter"]]
    return state


def _fit_by_rows(df: DataFrame, cols: list[str], max_iter: int, tol: float, lineage_limit: int) -> dict:
    """The same regressions from the rows, one aggregate for each feature and
    round, for tables with more missing patterns than the driver may hold."""
    d = len(cols)
    safe = {c: missing_safe(df, c).cast("double") for c in cols}
    stats = df.agg(
        *[F.avg(safe[c]).alias(f"mean{i}") for i, c in enumerate(cols)],
        *[F.count_if(is_missing(df, c)).alias(f"miss{i}") for i, c in enumerate(cols)],
        *[F.max(F.abs(safe[c])).alias(f"abs{i}") for i, c in enumerate(cols)],
        F.count(F.lit(1)).alias("n"),
    ).first()
    means = [stats[f"mean{i}"] for i in range(d)]
    nmiss = [int(stats[f"miss{i}"]) for i in range(d)]
    state = {"columns": cols, "means": means, "steps": [], "n_iter": 0}
    if d <= 1 or all(m == 0 for m in nmiss) or any(m is None for m in means):
        return state
    order = sorted(range(d), key=lambda i: (nmiss[i] / max(stats["n"], 1), i))
    norm_tol = tol * max(abs(stats[f"abs{i}"] or 0.0) for i in range(d))

    from pyspark import StorageLevel

    # each feature step aggregates the participating columns again: keep
    # just those (initial fill + missing masks) cached for the whole fit
    base = df.select(
        *[F.coalesce(safe[c], F.lit(means[i])).alias(f"__x{i}") for i, c in enumerate(cols)],
        *[is_missing(df, c).alias(f"__m{i}") for i, c in enumerate(cols)],
    ).persist(StorageLevel.MEMORY_AND_DISK)
    cur = base
    miss = {c: F.col(f"__m{i}") for i, c in enumerate(cols)}
    depth = 0
    for rnd in range(1, max_iter + 1):
        prev = cur.select("*", *[F.col(f"__x{i}").alias(f"__p{i}") for i in range(d)])
        cur = prev
        full = None
        for j in order:
            if nmiss[j] == 0:
                if full is None:
                    full = _step_stats(cur, cols, None, miss)
                n, mean, S = full
            else:
                n, mean, S = _step_stats(cur, cols, j, miss)
            others, coef, intercept = _regress(n, mean, S, j)
            state["steps"].append({"round": rnd, "feature": j, "others": others, "coef": coef.tolist(), "intercept": float(intercept)})
            if nmiss[j]:
                pred = F.lit(float(intercept))
                for i, b in zip(others, coef):
                    pred = pred + F.lit(float(b)) * F.col(f"__x{i}")
                cur = cur.withColumn(f"__x{j}", F.when(F.col(f"__m{j}"), pred).otherwise(F.col(f"__x{j}")))
                depth += 1
        state["n_iter"] = rnd
        change = sum((F.abs(F.col(f"__x{i}") - F.col(f"__p{i}")) for i in range(d)), F.lit(0.0))
        inf_norm = cur.agg(F.max(change)).first()[0] or 0.0
        cur = cur.drop(*[f"__p{i}" for i in range(d)])
        if inf_norm < norm_tol:
            break
        if depth >= lineage_limit:
            from sparkprep.session import ensure_checkpoint_dir

            ensure_checkpoint_dir(cur.sparkSession)
            cur = cur.checkpoint(eager=True)
            depth = 0
    base.unpersist()
    return state


def apply_mice(df: DataFrame, state: dict) -> DataFrame:
    """Replay the fitted sequence: mean fill, then each regression step
    on the cells that are missing in ``df``."""
    cols = [c for c in state["columns"]]
    present = [c for c in cols if c in df.columns]
    if len(present) != len(cols):
        return df
    d = len(cols)
    means = state["means"]
    x = {i: F.coalesce(missing_safe(df, c).cast("double"), F.lit(means[i])) for i, c in enumerate(cols) if means[i] is not None}
    if len(x) != d:
        return df
    m = {i: is_missing(df, c) for i, c in enumerate(cols)}
    cur = df.select("*", *[x[i].alias(f"__x{i}") for i in range(d)], *[m[i].alias(f"__m{i}") for i in range(d)])
    for st in state["steps"]:
        j = st["feature"]
        pred = F.lit(st["intercept"])
        for i, b in zip(st["others"], st["coef"]):
            pred = pred + F.lit(b) * F.col(f"__x{i}")
        cur = cur.withColumn(f"__x{j}", F.when(F.col(f"__m{j}"), pred).otherwise(F.col(f"__x{j}")))
    idx = {c: i for i, c in enumerate(cols)}
    return cur.select(*[F.col(f"__x{idx[c]}").alias(c) if c in idx else qcol(c) for c in df.columns])


# ----------------------------------------------------------- eager action
def handle_missing(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str = "impute",
    impute: dict | None = None,
) -> Result:
    """Eager ``handle_missing``: ``drop_rows``, ``impute``, or a numeric
    strategy by name (``mice``, ``median``, ``mean``, ``constant``).

    ``impute.numeric``: ``mice`` (default) | ``median`` | ``mean`` |
    ``constant``; an all-missing numeric column gets ``constant_value``;
    only numeric columns with missing values take part in MICE.
    ``impute.categorical``: ``most_frequent`` (default) | ``constant``; an
    all-missing column gets ``constant_categorical``.
    """
    from sparkprep.operators.rows import drop_missing_rows

    if not columns:
        return eager(df, {"imputation_values": {}})
    if strategy == "drop_rows":
        return drop_missing_rows(df, list(columns))
    if strategy in ("mice", "median", "mean", "constant"):
        strategy, impute = "impute", {**(impute or {}), "numeric": strategy}
    if strategy != "impute":
        raise ValueError(f"handle_missing: unknown strategy '{strategy}'")
    cfg = impute or {}
    num_strategy = cfg.get("numeric", "mice")
    cat_strategy = cfg.get("categorical", "most_frequent")
    constant_value = cfg.get("constant_value", 0)
    constant_cat = cfg.get("constant_categorical", "MISSING")

    live = [c for c in columns if c in df.columns]
    if not live:
        return eager(df, {"imputation_values": {}})
    counts = df.agg(
        *[F.count_if(is_missing(df, c)).alias(f"m::{c}") for c in live],
        *[F.count_if(~is_missing(df, c)).alias(f"o::{c}") for c in live],
    ).first()
    with_missing = [c for c in live if counts[f"m::{c}"] > 0]
    num = [c for c in with_missing if is_numeric(field_type(df, c)) and not is_bool(field_type(df, c))]
    cat = [c for c in with_missing if c not in num]
    diff: dict = {"imputation_values": {}}
    out = df

    empty_num = [c for c in num if counts[f"o::{c}"] == 0]
    if empty_num:
        out = fill_values(out, {c: constant_value for c in empty_num})
        for c in empty_num:
            diff["imputation_values"][c] = constant_value
    rest = [c for c in num if c not in empty_num]
    state: dict = {}
    if rest:
        if num_strategy == "mice":
            st = fit_mice(out, num)
            out = apply_mice(out, st)
            state["mice"] = st
            for c in rest:
                diff["imputation_values"][c] = "MICE_Estimated"
        else:
            fills = fit_numeric_simple(out, rest, num_strategy, constant_value)
            out = fill_values(out, fills)
            state["numeric"] = fills
            diff["imputation_values"].update(fills)

    if cat:
        fills = {}
        modes_ = fit_mode(df, cat) if cat_strategy == "most_frequent" else {}
        for c in cat:
            if counts[f"o::{c}"] == 0:
                fills[c] = constant_cat
            elif cat_strategy == "most_frequent":
                fills[c] = modes_[c] if modes_[c] is not None else constant_cat
            else:
                fills[c] = constant_cat
        out = fill_values(out, fills)
        state["categorical"] = fills
        diff["imputation_values"].update(fills)
    return eager(out, diff, [], state=state)
