"""Plan model (L5) and fixed plans."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

ACTIONS = [
    "fix_column_names",
    "normalize_text",
    "cast_type",
    "deduplicate",
    "add_missing_indicators",
    "semantic_missing_to_category",
    "handle_missing",
    "remove_outliers",
    "clip_outliers",
    "transform_numeric_skewed",
    "bin_numeric",
    "drop_column",
    "group_rare_categories",
    "encode_categorical",
    "encode_categorical_per_column",
    "select_features",
    "scale_features",
]
SEVERITIES = ("info", "warning", "critical")


@dataclass
class Action:
    action: str
    rationale: str = ""
    target_columns: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def known(self) -> bool:
        """Unknown actions are allowed: a registered stage may carry them out, else they are recorded as skipped."""
        return self.action in ACTIONS


@dataclass
class Diagnostic:
    code: str
    severity: str
    message: str
    evidence: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity '{self.severity}'")


@dataclass
class Plan:
    dataset_summary: str = ""
    reasoning_steps: list[str] = field(default_factory=list)
    actions: list[Action] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)

    @classmethod
    def from_dict(cls, d: dict) -> Plan:
        return cls(
            dataset_summary=d.get("dataset_summary", "") or "",
            reasoning_steps=list(d.get("reasoning_steps") or []),
            actions=[
                Action(
                    action=a["action"],
                    rationale=a.get("rationale", "") or "",
                    target_columns=list(a.get("target_columns") or []),
                    params=dict(a.get("params") or {}),
                )
                for a in d.get("actions") or []
            ],
            diagnostics=[Diagnostic(**x) for x in d.get("diagnostics") or []],
        )

    @classmethod
    def from_json(cls, text: str) -> Plan:
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)


def empty_plan() -> Plan:
    return Plan()


def deterministic_plan() -> Plan:
    """Fixed recipe: fix names -> impute -> deduplicate -> normalise text."""
    return Plan(
        actions=[
            Action("fix_column_names", "Standardise column names (lowercase, strip, underscores)."),
            Action("handle_missing", "Impute missing values.", params={"strategy": "impute"}),
            Action("deduplicate", "Remove exact duplicate rows."),
            Action("normalize_text", "Strip leading/trailing whitespace; collapse internal whitespace."),
        ]
    )
