"""The check types: each takes a context, runs its plan, and returns a result.

Plans end in verdicts and bounded samples; nothing else is collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import HashPolicy
from ..operators import columns, counts, custom_sql, expectations, rows, stats
from ..operators.sampling import mismatch_ranges
from ..sinks.artifacts import Artifacts
from ..sinks.persistence import append, read_stats
from ..sources.sides import Source, align, split_list
from .config import CheckConfig, ConfigError, Storage, TableConfig, take
from .results import FAIL, PASS, RECORDED, SKIP, CheckResult

CHECKS: dict[str, Callable[[Context], CheckResult]] = {}


def check(name: str):
    """Registers a check type."""

    def add(f):
        CHECKS[name] = f
        return f

    return add


@dataclass
class Context:
    """All that a check may use.  source and target read lazily."""

    spark: SparkSession
    table: TableConfig
    config: CheckConfig
    source_connection: Source
    target_connection: Source
    hashing: HashPolicy = HashPolicy()
    variables: dict[str, Any] = field(default_factory=dict)
    artifacts: Artifacts = field(default_factory=Artifacts)
    run_id: str = "run"

    @cached_property
    def source(self) -> DataFrame:
        return self.source_connection.read(self.table.source)

    @cached_property
    def target(self) -> DataFrame:
        return self.target_connection.read(self.table.target)

    @property
    def now(self) -> datetime:
        return self.variables["run_timestamp"]

    def side(self, default: str = "source") -> str:
        on = str(self.config.get("on", default=default)).lower()
        if on not in ("source", "target"):
            raise ConfigError(f"{self.config.type}: on is source or target, not {on!r}")
        return on

    def relation(self, side: str | None = None) -> DataFrame:
        return self.source if (side or self.side()) == "source" else self.target

    def connection(self, side: str) -> Source:
        return self.source_connection if side == "source" else self.target_connection

    def result(self, ok: bool | str, **details: Any) -> CheckResult:
        return CheckResult(self.table.name, self.config.type, ok if isinstance(ok, str) else PASS if ok else FAIL, details)

    def aligned(self):
        c = self.config
        return align(include_map=c.get("include_map"), include=c.get("include"), include_source=c.get("include_source"), include_target=c.get("include_target"), column_map=self.table.column_map, exclude=c.get("exclude"))

    def ranges(self, label: str, rule: dict | None = None) -> dict[str, Any]:
        """Where counts differ: the largest ranges for the details, all of them in a file if files are kept."""
        sampling, ids = self.config.sampling(rule), self.config.ids(rule)
        if not sampling or not ids:
            return {}
        found = mismatch_ranges(self.source, self.target, *ids, sampling)
        if found is None:
            return {}
        out = {"mode": sampling.mode, "ranges": [r.asDict() for r in found.top(sampling.max_ranges).collect()], "truncated": found.truncated, "start": found.start, "end": found.end}
        uri = self.artifacts.write(found.df.orderBy("range_start"), label, self.variables, self.run_id)
        return {"mismatch_sampling": out | ({"mismatch_csv_uri": uri} if uri else {})}


def preview(df: DataFrame, n: int) -> list[dict[str, Any]]:
    """The first n rows in the order of df."""
    return [r.asDict(recursive=True) for r in df.limit(n).collect()]


def _orders(x: Context, found) -> tuple[list[str], list[str], list[str]]:
    """How previews are ordered: names, and each side's expressions.  order_by_source and order_by_target go before
    order_by, which names aligned columns, and that before the sides' own order_by; rows are ordered by keys last."""
    listed = lambda v: split_list(v) if isinstance(v, str) else list(v or [])
    c = x.config
    by = {n: (s, t) for n, s, t in zip(found.names, found.source, found.target, strict=True)}
    parts = lambda v: re.fullmatch(r"(?is)(.*?)(?:\s+(asc|desc))?\s*", v).groups()
    named = [(parts(o)[1], by.get(parts(o)[0], (parts(o)[0],) * 2)) for o in listed(c.get("order_by"))]
    s = [parts(o) for o in listed(c.get("order_by_source"))] or [(e[0], d) for d, e in named] or [parts(o) for o in listed(x.table.source.order_by)]
    t = [parts(o) for o in listed(c.get("order_by_target"))] or [(e[1], d) for d, e in named] or [parts(o) for o in listed(x.table.target.order_by)]
    n = max(len(s), len(t))
    pad = lambda v: v + [("NULL", None)] * (n - len(v))
    names = [f"by__{i} {a[1] or b[1] or 'asc'}" for i, (a, b) in enumerate(zip(pad(s), pad(t), strict=True))]
    return names, [e for e, _ in pad(s)], [e for e, _ in pad(t)]


@check("row_count")
def row_count(x: Context) -> CheckResult:
    """Tolerances are shown but not applied."""
    row = counts.row_count(x.source, x.target).first()
    ok = row["status"] == PASS
    extra = {} if ok else x.ranges("row_count")
    return x.result(ok, source_count=row["source_count"], target_count=row["target_count"], config_summary=x.config.tolerances(), **extra)


def _rule(raw: dict, c: CheckConfig) -> counts.Rule:
    both = raw.get("column") or raw.get("col") or "*"
    tolerance = lambda k: raw.get(k) if raw.get(k) is not None else c.get(k)
    return counts.Rule(raw.get("method", "count"), raw.get("source_column") or raw.get("source_col") or both, raw.get("target_column") or raw.get("target_col") or both, tolerance("tolerance_abs"), tolerance("tolerance_pct"))


@check("aggregations")
def aggregations(x: Context) -> CheckResult:
    raw = x.config.need("rules")
    found = counts.aggregations(x.source, x.target, [_rule(r, x.config) for r in raw]).orderBy("rule_idx").collect()
    out = []
    for r, config in zip(found, raw, strict=True):
        one = {"method": r["method"], "column": config.get("column") or config.get("col"), "source": r["source_text"], "target": r["target_text"], "pass": r["pass"]}
        if not r["pass"] and r["method"] in ("count", "distinct_count"):
            one |= x.ranges(f"aggregations_{r['rule_idx']}", config)
        out.append(one)
    return x.result(all(r["pass"] for r in out), rules=out)


def _key(x: Context) -> tuple[str, str]:
    found = x.aligned()
    if len(found.names) != 1:
        raise ConfigError(f"{x.config.type}: exactly one key is required")
    return found.source[0], found.target[0]


@check("group_aggregations")
def group_aggregations(x: Context) -> CheckResult:
    raw = x.config.get("rules", default=[{"method": "count"}])
    top_n = int(x.config.get("top_n", default=50))
    groups = counts.group_aggregations(x.source, x.target, [_rule(r, x.config) for r in raw], *_key(x)).persist()
    try:
        totals = {r["rule_idx"]: r for r in groups.groupBy("rule_idx").agg(F.count_if(~F.col("pass")).alias("failed"), F.count(F.lit(1)).alias("groups")).collect()}
        failed = sum(r["failed"] for r in totals.values())
        sample = [r.asDict() for r in counts.differing(groups, top_n).collect()] if failed else []
    finally:
        groups.unpersist()
    rules = [{"method": r.get("method", "count"), "pass": i not in totals or totals[i]["failed"] == 0, "failed": totals[i]["failed"] if i in totals else 0} for i, r in enumerate(raw)]
    return x.result(not failed, rules=rules, failed_partitions=failed, diff_sample=sample)


@check("partitions")
def partitions(x: Context) -> CheckResult:
    column = x.config.get("column", "col", default="*")
    groups = counts.partitions(x.source, x.target, *_key(x), x.config.get("method", default="count"), column).persist()
    try:
        n = groups.agg(F.count_if(~F.col("pass")).alias("failed"), F.count("source").alias("s"), F.count("target").alias("t")).first()
        sample = [r.asDict() for r in counts.differing(groups, int(x.config.get("top_n", default=50))).collect()] if n["failed"] else []
    finally:
        groups.unpersist()
    return x.result(not n["failed"], failed_partitions=n["failed"], source_partitions=n["s"], target_partitions=n["t"], diff_sample=sample)


@check("hash_diff")
def hash_diff(x: Context) -> CheckResult:
    found = x.aligned()
    row = rows.hash_diff(*found.apply(x.source, x.target), found.names, x.hashing).first()
    return x.result(row["status"], algorithm=x.hashing.algorithm, canonical=found.names, missing_count=row["missing_count"], extra_count=row["extra_count"])


@check("join_rowdiff")
def join_rowdiff(x: Context) -> CheckResult:
    keys = x.config.need("join_keys")
    s_keys, t_keys = keys.get("source") or [], keys.get("target") or []
    if not s_keys or len(s_keys) != len(t_keys):
        raise ConfigError("join_rowdiff: join_keys needs as many source as target expressions")
    found = x.aligned()
    names = [f"k{i}" for i in range(1, len(s_keys) + 1)]
    order, s_order, t_order = _orders(x, found)
    pick = lambda df, k, e, o: df.select(*[F.expr(a).alias(n) for a, n in zip(k, names, strict=True)], *[F.expr(a).alias(n) for a, n in zip(e, found.names, strict=True)], *[F.expr(a).alias(f"by__{i}") for i, a in enumerate(o)])
    own = {r.get("column") or r.get("col"): rows.Tolerance(r.get("tolerance_abs"), r.get("tolerance_pct")) for r in x.config.get("rules", default=[])}
    diff = rows.RowDiff(pick(x.source, s_keys, found.source, s_order), pick(x.target, t_keys, found.target, t_order), names, found.names, rows.Tolerance(x.config.get("tolerance_abs"), x.config.get("tolerance_pct")), own, order)
    diff.differing = diff.differing.persist()  # the rows that differ alone: one join gives the summary and all previews
    try:
        return _reported(x, diff, found)
    finally:
        diff.differing.unpersist()


def _reported(x: Context, diff: rows.RowDiff, found) -> CheckResult:
    row = diff.summary().first()
    details = {"canonical": found.names, "missing_count_on_target": row["missing_count_on_target"], "extra_count_on_target": row["extra_count_on_target"], "mismatch_total_estimate": row["mismatch_total"]}
    if row["status"] != PASS:
        n = int(x.variables.get("max_rows_preview") or 1000)
        for name, count, df in (("missing_on_target", row["missing_count_on_target"], diff.missing), ("extra_on_target", row["extra_count_on_target"], diff.extra), ("mismatch_sample", row["mismatch_total"], diff.cells)):
            if count:
                listed = df()
                details[name] = preview(listed if diff.order else listed.orderBy(*diff.keys), n)
    return x.result(row["status"], **details)


@check("schema_drift")
def schema_drift(x: Context) -> CheckResult:
    drift = columns.schema_drift(x.source, x.target, case_sensitive=bool(x.config.get("case_sensitive", default=False)), expected=x.config.get("expected_columns")).collect()
    by_kind: dict[str, list] = {}
    for r in drift:
        both = {"column": r["column"], "source": r["source_type"], "target": r["target_type"]}
        by_kind.setdefault(r["kind"], []).append(both if r["kind"] in ("type", "nullability") else r["column"])
    return x.result(not drift, **by_kind)


@check("freshness")
def freshness(x: Context) -> CheckResult:
    row = columns.freshness(x.relation(), x.config.need("column", "col"), float(x.config.need("max_lag_minutes")), x.now).first()
    return x.result(row["status"], side=x.side(), latest=row["latest"], lag_minutes=row["lag_minutes"], max_lag_minutes=x.config.get("max_lag_minutes"))


@check("domain")
def domain(x: Context) -> CheckResult:
    c = x.config
    rules = {"allowed": c.get("allowed_values", "include_values"), "excluded": c.get("exclude_values"), "regex": c.get("regex"), "low": c.get("min"), "high": c.get("max")}
    row = columns.domain(x.relation(), c.need("column", "col"), tolerance_abs=c.get("tolerance_abs", default=0), tolerance_pct=c.get("tolerance_pct", default=0), **rules).first()
    return x.result(row["status"], side=x.side(), column=c.get("column", "col"), invalid_count=row["invalid_count"], total_count=row["total_count"], invalid_pct=row["invalid_pct"])


def _first(df: DataFrame) -> Any:
    row = df.first()
    value = row[0] if row else None
    return value.asDict(recursive=True) if hasattr(value, "asDict") else value


@check("custom_sql")
def custom_sql_check(x: Context) -> CheckResult:
    c = x.config
    tolerances = {"tol_abs": c.get("tolerance_abs"), "tol_pct": c.get("tolerance_pct"), "tol_sec": c.get("tolerance_time_sec"), "tol_min": c.get("tolerance_time_min")}
    mode = c.get("mode", default="single")
    if mode == "dual":
        a, b = (_first(x.connection(s).sql(c.need(f"sql_{s}"))) for s in ("source", "target"))
        return x.result(custom_sql.dual(a, b, c.get("compare_mode", default="equals"), **tolerances), mode=mode, source=a, target=b)
    if mode != "single":
        raise ConfigError(f"custom_sql: unknown mode {mode!r}")
    value = _first(x.connection(x.side()).sql(c.need("sql")))
    return x.result(custom_sql.single(value, c.get("expected_result"), **tolerances), mode=mode, result=value, expected_result=c.get("expected_result"))


def _storage(x: Context) -> Storage | None:
    raw = x.config.get("stats_storage")
    if raw:
        return take(Storage, raw, "stats_storage")
    table = x.config.get("stats_table") or x.variables.get("stats_table")
    return Storage(table) if table else None


@check("table_stats")
def table_stats(x: Context) -> CheckResult:
    storage, metrics = _storage(x), x.config.metrics()
    if not storage or not metrics:
        return x.result(SKIP, reason="no stats_storage" if not storage else "no metrics")
    on = str(x.config.get("on", default="both")).lower()
    time = lambda s: x.config.get(f"time_column_{s}", "time_column")
    chosen = {s: (x.relation(s), time(s)) for s in ("source", "target") if on in (s, "both")}
    if not chosen or any(t is None for _, t in chosen.values()):
        raise ConfigError("table_stats: on is source, target or both, and a time column is required")
    granularity = x.config.get("time_granularity", default="month")
    df = stats.table_stats(chosen, granularity, metrics, table_name=x.table.name, run_id=x.run_id, env=x.variables.get("env"), computed_at=x.now).persist()
    try:
        n = df.count()
        if n:
            append(df, storage, partition_by="table_name")
    finally:
        df.unpersist()
    return x.result(RECORDED if n else SKIP, rows=n, stats_table=storage.table, granularity=granularity)


@check("stats_compare")
def stats_compare(x: Context) -> CheckResult:
    storage = _storage(x)
    metrics = [m if isinstance(m, str) else m.get("name") or f"{m['method']}:{m.get('column', '*')}" for m in x.config.get("metrics", default=[])]
    if not storage or not metrics or not x.config.windows():
        return x.result(SKIP, reason="not configured")
    spec = stats.StatsCompare(x.config.get("table_name", default=x.table.name), metrics, x.config.windows(), x.config.get("tolerance_abs"), x.config.get("tolerance_pct"), x.config.adaptive_rules(), x.config.severity_rules())
    stored = read_stats(x.spark, storage)
    found = stats.stats_compare(stored, spec, x.now) if stored is not None else None
    if found is None:
        return x.result(SKIP, reason="no windows" if stored is not None else "no stored statistics")
    found = found.persist()
    try:
        n = found.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("pass")).alias("failed"), F.max(F.when(~F.col("pass"), F.expr("array_position(array('INFO', 'WARNING', 'CRITICAL'), severity)"))).alias("worst")).first()
        mismatches = [r.asDict() for r in stats.worst(found).collect()] if n["failed"] else []
    finally:
        found.unpersist()
    if not n["n"]:
        return x.result(SKIP, reason="no stored statistics in the windows")
    out = x.result(not n["failed"], compared=n["n"], failed=n["failed"], mismatches=mismatches, stats_table=storage.table)
    out.severity = ("INFO", "WARNING", "CRITICAL")[n["worst"] - 1] if n["failed"] else None
    return out


def _expected(x: Context, results: list[tuple[str, DataFrame | None]]) -> CheckResult:
    done, skipped = [], [name for name, df in results if df is None]
    for name, df in results:
        if df is not None:
            row = df.first()
            done.append({"name": name, "total": row["total"], "failed": row["failed"], "status": row["status"]})
    if not done:
        return x.result(SKIP, reason="nothing supported to run", skipped=skipped)
    return x.result(all(d["status"] == PASS for d in done), results=done, skipped=skipped)


def _read_yaml(x: Context, rule: dict, file: str, inline: str) -> Any:
    import yaml

    text = rule.get(inline)
    if rule.get(file):
        with open(rule[file]) as f:
            text = f.read()
    return yaml.safe_load(text) if isinstance(text, str) else text


@check("ge_expectations")
def ge_expectations(x: Context) -> CheckResult:
    """Expectations of a suite file and inline ones, over the side or a query of its own."""
    rule = (x.config.get("rules", default=[{}]) or [{}])[0]
    side = rule.get("on") or x.side()
    df = x.connection(side).sql(rule["query"]) if rule.get("query") else x.relation(side)
    suite = _read_yaml(x, rule, "suite_file", "suite") or {}
    wanted = [*(suite.get("expectations") or []), *(rule.get("expectations") or [])]
    name = lambda e: e.get("expectation_type") or e.get("type")
    return _expected(x, [(name(e), expectations.expectation(df, name(e), e.get("kwargs") or {})) for e in wanted])


@check("soda_checks")
def soda_checks(x: Context) -> CheckResult:
    """Check lines, with the lists and patterns of valid values that they may carry."""
    rule = (x.config.get("rules", default=[{}]) or [{}])[0]
    parsed = _read_yaml(x, rule, "checks_file", "checks_yaml") or {}
    df = x.relation(rule.get("on") or x.side())
    out = []
    for lines in parsed.values():
        for line in lines or []:
            text, extra = (next(iter(line.items())) if isinstance(line, dict) else (line, None))
            extra = {k.replace(" ", "_"): v for k, v in (extra or {}).items() if isinstance(extra, dict)}
            known = {k: extra[k] for k in ("valid_values", "valid_regex", "valid_min", "valid_max") if k in extra}
            out.append((text, expectations.check_line(df, text, **known)))
    return _expected(x, out)
