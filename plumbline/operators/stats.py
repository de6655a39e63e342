"""Statistics by calendar period: computed in one pass, stored, and later compared with tolerances by age."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import periods
from ..functions.compare import EPS, equal_stat
from ..functions.severity import AdaptiveRule, SeverityRule, adaptive_columns, severity_column, tier_column
from .counts import METHODS


@dataclass(frozen=True)
class Metric:
    method: str
    column: str = "*"
    name: str | None = None

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; one of {', '.join(METHODS)}")
        if self.method != "count" and self.column == "*":
            raise ValueError(f"{self.method} needs a column")

    @property
    def label(self) -> str:
        return self.name or f"{self.method}:{self.column}"

    def aggregate(self) -> Column:
        if self.method == "count":
            return F.count(F.lit(1)) if self.column == "*" else F.count(F.expr(self.column))
        return {"distinct_count": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.method](F.expr(self.column))


def _number(df: DataFrame, metric: Metric):
    """What makes a number of a metric's value."""
    if metric.method in ("min", "max") and isinstance(df.select(F.expr(metric.column)).schema[0].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / 1e6
    return lambda c: c


def period_stats(df: DataFrame, time_column: str, granularity: str, metrics: list[Metric]) -> DataFrame:
    """A row a period and metric: period_start, period_end, period_key, metric_name, column_name, metric_value, row_count.

    All metrics come from one aggregation.  Rows without a time are left out.  The least and largest dates and times count
    as seconds since 1970.
    """
    start = periods.start_of(granularity, F.expr(time_column))
    number = {m: _number(df, m) for m in metrics}
    rows = df.withColumn("__start", start).where("__start is not null").groupBy("__start").agg(F.count(F.lit(1)).alias("__rows"), *[number[m](m.aggregate()).cast("double").alias(f"__m{i}") for i, m in enumerate(metrics)])
    cells = F.explode(F.array(*[F.struct(F.lit(m.label).alias("metric_name"), F.lit(None if m.column == "*" else m.column).cast("string").alias("column_name"), F.col(f"__m{i}").alias("metric_value")) for i, m in enumerate(metrics)])).alias("x")
    s = F.col("__start")
    return rows.select(s, "__rows", cells).select(s.alias("period_start"), periods.end_of(granularity, s).alias("period_end"), periods.key_of(granularity, s).alias("period_key"), "x.*", F.col("__rows").alias("row_count"))


def table_stats(sides: dict[str, tuple[DataFrame, str]], granularity: str, metrics: list[Metric], *, table_name: str, run_id: str, env: str | None, computed_at: datetime) -> DataFrame:
    """The stored form of period_stats() of each side (name: relation, time column)."""
    out = None
    for side, (df, time_column) in sides.items():
        one = period_stats(df, time_column, granularity, metrics)
        one = one.select(F.lit(run_id).alias("run_id"), F.lit(env).cast("string").alias("env"), F.lit(table_name).alias("table_name"), F.lit(side).alias("side"), F.lit(time_column).alias("time_column"), F.lit(granularity).alias("period_granularity"), "period_start", "period_end", "period_key", "metric_name", "column_name", "metric_value", "row_count", F.lit(computed_at).cast("timestamp_ntz").alias("computed_at"))
        out = one if out is None else out.union(one)
    return out


@dataclass(frozen=True)
class StatsWindow:
    period_granularity: str
    lookback_days: float | None = None
    lookback_weeks: float | None = None
    lookback_months: int | None = None
    lookback_years: int | None = None

    def start(self, now: datetime) -> datetime | None:
        return periods.lookback(now, days=self.lookback_days, weeks=self.lookback_weeks, months=self.lookback_months, years=self.lookback_years)


@dataclass(frozen=True)
class StatsCompare:
    table_name: str
    metrics: list[str]
    windows: list[StatsWindow]
    tolerance_abs: float | None = None
    tolerance_pct: float | None = None
    adaptive: list[AdaptiveRule] = field(default_factory=list)
    severity: list[SeverityRule] = field(default_factory=list)


def naive_utc(now: datetime) -> datetime:
    return now.astimezone(timezone.utc).replace(tzinfo=None) if now.tzinfo else now


def stats_compare(stats: DataFrame, spec: StatsCompare, as_of: datetime) -> DataFrame | None:
    """A row a metric and period in any window: both values, diff, percentages, age, tolerances, reason, pass, severities.

    None if no window has a length.  Of several stored rows for a side, period and metric the last computed counts.  The
    windows are one filter on the stored rows, so overlapping ones don't repeat rows; source and target are paired by one
    aggregation.
    """
    now = naive_utc(as_of)
    tests = None
    for w in spec.windows:
        if (start := w.start(now)) is not None:
            one = (F.col("period_granularity") == w.period_granularity) & (F.col("period_start") >= F.lit(start).cast("timestamp_ntz"))
            tests = one if tests is None else tests | one
    if tests is None:
        return None
    key = ["metric_name", "period_granularity", "period_key"]
    rows = stats.where((F.col("table_name") == spec.table_name) & F.col("metric_name").isin(list(spec.metrics))).where(tests)
    of = lambda side, c: F.max_by(F.when(F.col("side") == side, F.col(c)), F.when(F.col("side") == side, F.col("computed_at")))
    both = rows.groupBy(*key).agg(F.max("period_start").alias("period_start"), of("source", "metric_value").alias("source"), of("target", "metric_value").alias("target"), of("source", "row_count").alias("source_rows"), of("target", "row_count").alias("target_rows"))
    seconds = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("period_start").cast("timestamp"))
    s, t = F.col("source"), F.col("target")
    diff = F.abs(s - t)
    tol_abs, tol_pct = adaptive_columns(seconds.cast("double"), spec.tolerance_abs, spec.tolerance_pct, spec.adaptive)
    out = both.withColumns({
        "diff": s - t,
        "pct_diff": diff * 100.0 / F.greatest(F.abs(s), F.abs(t), F.lit(EPS)),
        "diff_pct": diff * 100.0 / F.greatest(F.abs(t), F.lit(EPS)),
        "age_days": F.floor(seconds / 86400).cast("long"),
        "tolerance_abs": tol_abs,
        "tolerance_pct": tol_pct,
        "reason": F.when(s.isNull() & t.isNull(), "missing_both").when(s.isNull(), "missing_source").when(t.isNull(), "missing_target"),
    })
    out = out.withColumn("pass", equal_stat(s, t, F.col("tolerance_abs"), F.col("tolerance_pct")))
    out = out.withColumn("reason", F.when(~F.col("pass"), F.coalesce("reason", F.lit("difference"))))
    bounds = {"age_days": F.col("age_days"), "pct_diff": F.col("pct_diff"), "abs_diff": F.abs("diff"), "reason": F.col("reason")}
    out = out.withColumn("severity", F.when(~F.col("pass"), severity_column(bounds, spec.severity)))
    return out.withColumn("severity_level", tier_column(F.col("age_days")))


def worst(compared: DataFrame, n: int = 10) -> DataFrame:
    """The failing periods: those with a side missing first, then by size of the difference."""
    return compared.where(~F.col("pass")).orderBy(F.col("diff").isNull().desc(), F.abs("diff").desc(), "metric_name", "period_key").limit(n)

