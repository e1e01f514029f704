"""Result type shared by the eager operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Result:
    """``(df, diff, warnings)`` of an eager operator.

    The audit is lazy: ``diff`` / ``warnings`` run their (single) Spark job
    only when read, so a plan run without audit pays no extra job.
    """

    df: DataFrame
    _audit: Callable[[], tuple[dict, list[str]]] | None = None
    _diff: dict | None = None
    _warnings: list[str] | None = None
    state: dict[str, Any] = field(default_factory=dict)

    def _materialise(self) -> None:
        if self._diff is None:
            if self._audit is None:
                self._diff, self._warnings = {}, []
            else:
                d, w = self._audit()
                self._diff, self._warnings = d, list(w)

    @property
    def diff(self) -> dict:
        self._materialise()
        return self._diff  # type: ignore[return-value]

    @property
    def warnings(self) -> list[str]:
        self._materialise()
        return self._warnings  # type: ignore[return-value]

    def __iter__(self):
        yield self.df
        yield self.diff
        yield self.warnings


def eager(df: DataFrame, diff: dict, warnings: list[str] | None = None, state: dict | None = None) -> Result:
    return Result(df=df, _diff=diff, _warnings=list(warnings or []), state=state or {})


def lazy(df: DataFrame, audit: Callable[[], tuple[dict, list[str]]], state: dict | None = None) -> Result:
    return Result(df=df, _audit=audit, state=state or {})


def require_columns(df: DataFrame, cols, op: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{op}: column(s) {missing} do not exist")


def needs_columns(op: str, columns) -> None:
    if not columns or not isinstance(columns, (list, tuple)):
        raise ValueError(f"{op} requires 'columns' as a non-empty list")


def one_of(op: str, name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{op} '{name}' must be one of: {' | '.join(map(str, allowed))}")
