"""Results of checks and runs, and their stored form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.severity import highest

PASS, FAIL, SKIP, RECORDED = "PASS", "FAIL", "SKIP", "RECORDED"

#: The columns of stored rows.
RUNS_SCHEMA = "run_id string NOT NULL, env string, run_label string, started_at timestamp, finished_at timestamp, overall_status string, pass_count long, fail_count long, skip_count long, table_count long, dag_id string, task_id string, extra_context string, created_at timestamp"
CHECKS_SCHEMA = "run_id string NOT NULL, table_name string, check_type string, check_name string, rule_id long, status string, severity string, method string, metric_name string, column_name string, group_key string, period_granularity string, period_start timestamp, period_end timestamp, period_key string, source_value double, target_value double, diff_abs double, diff_pct double, mismatch_csv_uri string, stats_table_ref string, extra_context string, created_at timestamp"
STATS_SCHEMA = "run_id string, env string, table_name string NOT NULL, side string NOT NULL, time_column string, period_granularity string, period_start timestamp_ntz, period_end timestamp_ntz, period_key string, metric_name string NOT NULL, column_name string, metric_value double, row_count long, computed_at timestamp_ntz"
#: Characters of details that are stored.
DETAILS = 1024


@dataclass
class CheckResult:
    table: str
    check_type: str
    status: str
    details: dict[str, Any] = field(default_factory=dict)
    severity: str | None = None


@dataclass
class RunResult:
    overall_status: str
    checks: list[CheckResult]
    overall_severity: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)

    def count(self, status: str) -> int:
        return sum(c.status == status for c in self.checks)


def summed(checks: list[CheckResult], **metadata: Any) -> RunResult:
    """FAIL if any check failed; the severity is the highest of those, WARNING where one has none."""
    failed = [c for c in checks if c.status == FAIL]
    return RunResult(FAIL if failed else PASS, checks, highest(*(c.severity or "WARNING" for c in failed)), metadata)


def csv_links(value: Any) -> list[str]:
    """All addresses of files under keys that end in csv_uri, wherever they lie, in order and once."""
    found: list[str] = []
    if isinstance(value, dict):
        for k, v in value.items():
            found += [v] if isinstance(v, str) and str(k).endswith("csv_uri") else csv_links(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            found += csv_links(v)
    return list(dict.fromkeys(found))


def details_json(details: dict) -> str | None:
    return json.dumps(details, default=str, ensure_ascii=False)[:DETAILS] if details else None


def run_row(run: RunResult, *, run_id: str, env: str | None, run_label: str | None, started: datetime, finished: datetime) -> dict[str, Any]:
    tables = {c.table for c in run.checks}
    return {"run_id": run_id, "env": env, "run_label": run_label, "started_at": started, "finished_at": finished, "overall_status": run.overall_status, "pass_count": run.count(PASS), "fail_count": run.count(FAIL), "skip_count": run.count(SKIP), "table_count": len(tables) or None, "created_at": finished}


def check_row(check: CheckResult, *, run_id: str, created: datetime | None = None) -> dict[str, Any]:
    d = check.details
    mismatches = d.get("mismatches") or []
    first = mismatches[0] if mismatches and isinstance(mismatches[0], dict) else {}
    return {"run_id": run_id, "table_name": check.table, "check_type": check.check_type, "status": check.status, "severity": check.severity, "method": check.check_type, "metric_name": check.check_type, "period_key": first.get("period_key"), "mismatch_csv_uri": next(iter(csv_links(d)), None), "stats_table_ref": d.get("stats_table"), "extra_context": details_json(d), "created_at": created}


def frame(spark: SparkSession, rows: list[dict[str, Any]], schema: str) -> DataFrame:
    """Rows in the order of a stored schema; what a row lacks is NULL."""
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
