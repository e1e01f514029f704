"""Data-preparation operators: eager form ``op(df, ...) -> Result`` and, for
fitted ones, ``fit_*`` returning JSON-able state plus ``apply_*``."""
