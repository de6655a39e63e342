"""Checks of one side's columns, and of the two sides' schemas."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRIFT_SCHEMA = "kind string, column string, source_type string, target_type string"
#: Names of the same type.
ALIASES = {"integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint", "real": "float", "bool": "boolean", "timestamp_ntz": "timestamp", "numeric": "decimal(10,0)", "varchar": "string", "char": "string", "text": "string"}


def violation(column: str, *, allowed: list | None = None, excluded: list | None = None, regex: str | None = None, low=None, high=None) -> Column:
    """Whether a value breaks any of the rules.  NULL breaks only a rule that names NULL.

    allowed without NULL in it takes NULL as unknown, so NULLs aren't counted; excluded with NULL counts them.
    """
    c = F.col(column) if column.isidentifier() else F.expr(column)
    tests: list[Column] = []
    split = lambda values: ([v for v in values if v is not None], any(v is None for v in values))
    if allowed is not None:
        members, null = split(allowed)
        outside = ~c.isin(members) if members else F.lit(True)
        tests.append(c.isNotNull() & outside if null or not members else outside)
    if excluded is not None:
        members, null = split(excluded)
        tests.append((c.isin(members) if members else F.lit(False)) | (c.isNull() if null else F.lit(False)))
    if regex is not None:
        tests.append(~c.cast("string").rlike(regex))
    if low is not None:
        tests.append(c < F.lit(low))
    if high is not None:
        tests.append(c > F.lit(high))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def domain(df: DataFrame, column: str, *, tolerance_abs: float = 0, tolerance_pct: float = 0, **rules) -> DataFrame:
    """One row: invalid_count, total_count (1 at least), invalid_pct, status (PASS within either tolerance)."""
    bad = violation(column, **rules)
    out = df.agg(F.count_if(bad).alias("invalid_count"), F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total_count"))
    out = out.withColumn("invalid_pct", F.col("invalid_count") * 100.0 / F.col("total_count"))
    ok = (F.col("invalid_count") <= float(tolerance_abs)) | (F.col("invalid_pct") <= float(tolerance_pct))
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def freshness(df: DataFrame, column: str, max_lag_minutes: float, as_of: datetime | Column) -> DataFrame:
    """One row: latest, lag_minutes to as_of, status; an empty column fails.  Times without a zone are UTC."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    out = df.agg(F.max(F.expr(column)).alias("latest"))
    out = out.withColumn("lag_minutes", (micros(now) - micros(F.col("latest"))) / F.lit(60e6))
    return out.withColumn("status", F.when(F.coalesce(F.col("lag_minutes") <= float(max_lag_minutes), F.lit(False)), "PASS").otherwise("FAIL"))


def type_name(data_type: T.DataType | str) -> str:
    name = data_type if isinstance(data_type, str) else data_type.simpleString()
    return ALIASES.get(name.lower(), name.lower())


def schema_drift(source: DataFrame, target: DataFrame, *, case_sensitive: bool = False, expected: list[str] | None = None) -> DataFrame:
    """A row a difference: missing_on_target, extra_on_target, type, nullability, missing_expected.  No job runs."""
    fold = (lambda s: s) if case_sensitive else str.lower
    s, t = ({fold(f.name): f for f in df.schema.fields} for df in (source, target))
    rows: list[tuple] = []
    rows += [("missing_on_target", n, type_name(f.dataType), None) for n, f in s.items() if n not in t]
    rows += [("extra_on_target", n, None, type_name(f.dataType)) for n, f in t.items() if n not in s]
    for n in s.keys() & t.keys():
        a, b = type_name(s[n].dataType), type_name(t[n].dataType)
        if a != b:
            rows.append(("type", n, a, b))
        if s[n].nullable != t[n].nullable:
            rows.append(("nullability", n, "null" if s[n].nullable else "not null", "null" if t[n].nullable else "not null"))
    for name in expected or []:
        if fold(name) not in s or fold(name) not in t:
            rows.append(("missing_expected", name, *(type_name(d[fold(name)].dataType) if fold(name) in d else None for d in (s, t))))
    return source.sparkSession.createDataFrame(sorted(rows, key=lambda r: r[:2]), DRIFT_SCHEMA)
