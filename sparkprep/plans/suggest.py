"""Profile-driven plan suggestion (L7) and target detection.

Re-aims the reference's planning rules without a language model: the rules
read the profile DataFrame that Spark computed (one row per column).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from sparkprep.operators.profile import profile
from sparkprep.plans.spec import Action, Plan

# Preferred target names and target-like names.
PREFERRED_TARGETS = ["target", "income", "label", "class", "y"]
TARGET_LIKE = {"target", "income", "label", "class", "y", "outcome", "price", "saleprice", "diagnosis"}
MISSING_DROP_RATIO = 0.40
ONE_HOT_MAX_CARDINALITY = 15
_ID_TOKEN = re.compile(r"(^|[\W_])(id|nbr|key)($|[\W_])")


def detect_target(columns: list[str]) -> tuple[str | None, bool]:
    """(target or None, is_training). Training when a target-like name exists."""
    target = next((p for p in PREFERRED_TARGETS if p in columns), None)
    is_training = any(c.lower() in TARGET_LIKE for c in columns)
    if target is None and is_training:
        target = next(c for c in columns if c.lower() in TARGET_LIKE)
    return target, is_training


def is_id_like(name: str, n_unique: int, n_rows: int) -> bool:
    """Name token ``id``/``nbr``/``key`` or every value distinct (not a
    substring test, which would match ``width``)."""
    return bool(_ID_TOKEN.search(name.lower())) or (n_rows > 0 and n_unique == n_rows)


def suggest_plan(df: DataFrame, target_column: str | None = None, model_family: str = "scaling_sensitive") -> Plan:
    """Without a target column the target-like name, if there is one, is
    taken. Rules: drop ID-like columns and columns with missing ratio > 0.40;
    impute the rest; fix names and normalise text; per-column encoding
    (ordinal for trees or cardinality > 15, else one-hot); clip outliers
    and scale for scaling-sensitive models; never scale for trees."""
    if target_column is None:
        target_column = detect_target(df.columns)[0]
    rows = profile(df, target_column).orderBy("position").collect()
    n_rows = df.count()
    drops, missing_cols, enc = [], [], {}
    for r in rows:
        c = r["column"]
        if c == target_column:
            continue
        if is_id_like(c, r["n_unique"], n_rows) or (r["missing_ratio"] or 0) > MISSING_DROP_RATIO:
            drops.append(c)
            continue
        if r["missing_count"]:
            missing_cols.append(c)
        if r["is_text_like"]:
            tree = model_family == "tree"
            enc[c] = "ordinal" if tree or r["n_unique"] > ONE_HOT_MAX_CARDINALITY else "one_hot"
    actions = [Action("fix_column_names", "Standardise column names.")]
    if drops:
        actions.append(Action("drop_column", "ID-like or mostly missing columns.", target_columns=drops))
    actions.append(Action("normalize_text", "Standardise strings."))
    if missing_cols:
        strategy = "median" if model_family == "tree" else "impute"
        actions.append(Action("handle_missing", "Impute missing values.", target_columns=missing_cols, params={"strategy": strategy}))
    if model_family != "tree":
        actions.append(Action("clip_outliers", "Linear / distance models are outlier-sensitive.", params={"method": "iqr", "iqr_k": 1.5}))
    if enc:
        actions.append(Action("encode_categorical_per_column", "Per-column encoding.", params={"column_encodings": enc, "default_method": "one_hot"}))
    if model_family != "tree":
        actions.append(Action("scale_features", "Scaling-sensitive model."))
    return Plan(dataset_summary=f"{len(rows)} columns, {n_rows} rows", actions=actions)
