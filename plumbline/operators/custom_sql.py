"""Verdicts on the first value of a query, or on the values of one query a side."""

from __future__ import annotations

from typing import Any

from ..functions.compare import as_time, equal_values, is_number

#: Results that mean failure.
FAILING = {"fail", "false", "error", "invalid"}
COMPARISONS = ("equals", "greater", "less")


def single(value: Any, expected: Any = None, **tolerances) -> bool:
    """A truth value as it is; with an expected result, equality to it; else numbers pass as 0 and text unless it says failure."""
    if value is None:
        return False
    if isinstance(value, bool):
        return value if expected is None else value == expected
    if expected is not None:
        if as_time(value) and isinstance(expected, str):
            from datetime import datetime

            expected = datetime.fromisoformat(expected)
        return equal_values(value, float(expected) if is_number(value) and isinstance(expected, str) else expected, **tolerances)
    if is_number(value):
        return value == 0
    if isinstance(value, str):
        return value.strip().lower() not in FAILING
    return True


def dual(source: Any, target: Any, mode: str = "equals", **tolerances) -> bool:
    if mode not in COMPARISONS:
        raise ValueError(f"unknown compare_mode {mode!r}; one of {', '.join(COMPARISONS)}")
    if mode == "equals":
        return equal_values(source, target, **tolerances)
    if source is None or target is None:
        return False
    a, b = (as_time(source), as_time(target)) if as_time(source) and as_time(target) else (source, target)
    if is_number(a) and is_number(b):
        a, b = float(a), float(b)
    return a > b if mode == "greater" else a < b
