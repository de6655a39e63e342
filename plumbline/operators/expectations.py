"""Expectations and check lines of two third-party vocabularies, the documented part, natively."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import violation


def expect_not_null(df: DataFrame, column: str, mostly: float = 1.0) -> DataFrame:
    """One row: total, failed (NULLs), status by the share that has to be present."""
    out = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr(column).isNull()).alias("failed"))
    ok = (F.col("total") - F.col("failed")) >= F.col("total") * float(mostly)
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def expect_row_count_between(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    out = df.agg(F.count(F.lit(1)).alias("total")).withColumn("failed", F.lit(0).cast("long"))
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col("total") >= low)
    if high is not None:
        ok = ok & (F.col("total") <= high)
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


#: Expectations by name: what makes the one-row result from a relation and the expectation's arguments.
EXPECTATIONS = {
    "expect_column_values_to_not_be_null": lambda df, kw: expect_not_null(df, kw["column"], kw.get("mostly", 1.0)),
    "expect_table_row_count_to_be_between": lambda df, kw: expect_row_count_between(df, kw.get("min_value"), kw.get("max_value")),
}


def expectation(df: DataFrame, name: str, kwargs: dict) -> DataFrame | None:
    """The result of an expectation, or None if it isn't one of those supported."""
    make = EXPECTATIONS.get(name)
    return make(df, kwargs) if make else None


_LINE = re.compile(r"^\s*(row_count|missing_count|missing_percent|invalid_count|invalid_percent|duplicate_count)\s*(?:\(\s*([^)]+?)\s*\))?\s*(<=|>=|!=|=|<|>)\s*([-+0-9.]+)\s*$")
_TESTS = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "!=": lambda a, b: a != b, "=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


def check_line(df: DataFrame, line: str, *, valid_values: list | None = None, valid_regex: str | None = None, valid_min=None, valid_max=None) -> DataFrame | None:
    """One row (total, failed, status) of a line such as ``missing_count(c) = 0``, or None if the line isn't supported."""
    m = _LINE.match(line)
    if not m:
        return None
    metric, column, op, bound = m.groups()
    if (metric == "row_count") == bool(column):
        return None
    total = F.count(F.lit(1))
    if metric == "row_count":
        failed = total
    elif metric.startswith("missing"):
        failed = F.count_if(F.expr(column).isNull())
    elif metric == "duplicate_count":
        failed = F.count(F.expr(column)) - F.count_distinct(F.expr(column))
    else:
        failed = F.count_if(F.coalesce(violation(column, allowed=valid_values, regex=valid_regex, low=valid_min, high=valid_max), F.lit(False)))
    out = df.agg(total.alias("total"), failed.alias("failed"))
    measured = F.col("failed") * 100.0 / F.greatest("total", F.lit(1)) if metric.endswith("percent") else F.col("failed").cast("double")
    return out.withColumn("status", F.when(_TESTS[op](measured, F.lit(float(bound))), "PASS").otherwise("FAIL"))
