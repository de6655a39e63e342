"""Severity of differences, tiers of age, and tolerances that depend on age."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The levels in rising order, and the ages in days from which a tier holds.
LEVELS = ("INFO", "WARNING", "CRITICAL")
TIERS = ((180, "HIGH"), (60, "MEDIUM"), (0, "LOW"))


def rank(level: str | None) -> int:
    """Place among the levels; unknown ones are INFO."""
    return LEVELS.index(level.upper()) if level and level.upper() in LEVELS else 0


def highest(*levels: str | None) -> str | None:
    known = [x for x in levels if x]
    return LEVELS[max(map(rank, known))] if known else None


@dataclass(frozen=True)
class SeverityRule:
    """Bounds that all have to hold; condition is only a label.  Fixed values: the names, which configurations use."""

    severity: str
    condition: str | None = None
    older_than_days: float | None = None
    newer_than_days: float | None = None
    tolerance_pct_exceeded_gte: float | None = None
    tolerance_pct_exceeded_lt: float | None = None
    tolerance_abs_exceeded_gte: float | None = None
    tolerance_abs_exceeded_lt: float | None = None
    reason: str | None = None

    def clauses(self) -> list[tuple[str, str, Any]]:
        pairs = (
            ("age_days", ">=", self.older_than_days), ("age_days", "<=", self.newer_than_days),
            ("pct_diff", ">=", self.tolerance_pct_exceeded_gte), ("pct_diff", "<", self.tolerance_pct_exceeded_lt),
            ("abs_diff", ">=", self.tolerance_abs_exceeded_gte), ("abs_diff", "<", self.tolerance_abs_exceeded_lt),
            ("reason", "=", self.reason),
        )
        return [p for p in pairs if p[2] is not None]

    def holds(self, context: dict[str, Any]) -> bool:
        values = dict(context)
        if values.get("diff") is not None and "abs_diff" not in values:
            values["abs_diff"] = abs(values["diff"])
        test = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, "=": lambda a, b: a == b}
        return all(values.get(k) is not None and test[op](values[k], bound) for k, op, bound in self.clauses())


def determine(context: dict[str, Any], rules: list[SeverityRule], default: str = "WARNING") -> str:
    """The severity of the first rule that holds."""
    return next((LEVELS[rank(r.severity)] for r in rules if r.holds(context)), default)


def severity_column(columns: dict[str, Column], rules: list[SeverityRule], default: str = "WARNING") -> Column:
    """determine() over columns named age_days, pct_diff, abs_diff and reason."""
    test = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, "=": lambda a, b: a == b}
    out = None
    for rule in rules:
        holds = F.lit(True)
        for name, op, bound in rule.clauses():
            holds = holds & F.coalesce(test[op](columns[name], F.lit(bound)), F.lit(False))
        level = F.lit(LEVELS[rank(rule.severity)])
        out = F.when(holds, level) if out is None else out.when(holds, level)
    return out.otherwise(default) if out is not None else F.lit(default)


def tier_column(age_days: Column) -> Column:
    out = None
    for days, name in TIERS[:-1]:
        out = F.when(age_days >= days, name) if out is None else out.when(age_days >= days, name)
    return out.otherwise(TIERS[-1][1])


@dataclass(frozen=True)
class AdaptiveRule:
    """Tolerances for periods of an age: last_hours (at most so old) or older_than_days (at least so old)."""

    when: str
    hours: float | None = None
    days: float | None = None
    tolerance_abs: float | None = None
    tolerance_pct: float | None = None

    def __post_init__(self):
        if self.when not in ("last_hours", "older_than_days"):
            raise ValueError(f"unknown adaptive rule {self.when!r}")
        if (self.hours if self.when == "last_hours" else self.days) is None:
            raise ValueError(f"{self.when} needs {'hours' if self.when == 'last_hours' else 'days'}")

    def column(self, age_seconds: Column) -> Column:
        return age_seconds <= self.hours * 3600 if self.when == "last_hours" else age_seconds >= self.days * 86400


def adaptive_columns(age_seconds: Column, base_abs: float | None, base_pct: float | None, rules: list[AdaptiveRule]) -> tuple[Column, Column]:
    """Tolerances by age (NULL: no period): those of the first rule that holds; what it leaves unset falls back to the base."""

    def one(base: float | None, name: str) -> Column:
        value = F.lit(base).cast("double")
        out = None
        for rule in rules:
            own = getattr(rule, name)
            v = value if own is None else F.lit(float(own))
            holds = F.coalesce(rule.column(F.when(age_seconds.isNotNull(), F.greatest(age_seconds, F.lit(0.0)))), F.lit(False))
            out = F.when(holds, v) if out is None else out.when(holds, v)
        return out.otherwise(value) if out is not None else value

    return one(base_abs, "tolerance_abs"), one(base_pct, "tolerance_pct")
