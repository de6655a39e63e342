"""From a configuration to a plan, and from a plan to results.

Tables run side by side, and checks within a table if asked; each check's Spark jobs carry a tag, so a check that takes too
long is really cancelled.  A check that raises is a failed check; it doesn't stop the others.
"""

from __future__ import annotations

import os
import time

import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import SparkSession

from ..sinks.alerts import dispatch
from ..sinks.artifacts import Artifacts
from ..sinks.log import Log
from ..sinks.persistence import persist_run
from ..sources.sides import Source
from .checks import CHECKS, Context
from .config import CheckConfig, Config, ConfigError, TableConfig
from .loading import rendered, window
from .results import FAIL, SKIP, CheckResult, RunResult, summed

#: Checks that write what later checks of the same table read; they go first.
WRITERS = ("table_stats",)


@dataclass
class Unit:
    """A table to check within a window."""

    table: TableConfig
    span: tuple[datetime, datetime]


def connection(name: str, env: dict[str, str] | None = None) -> str:
    env = os.environ if env is None else env
    if not env.get(name):
        raise ConfigError(f"the environment variable {name} is not set")
    return env[name]


def enabled(kind: str) -> bool:
    """False for the types named in PLUMBLINE_DISABLE_CHECKS."""
    return kind not in {x.strip() for x in os.environ.get("PLUMBLINE_DISABLE_CHECKS", "").split(",")}


def load_extra_checks() -> None:
    """Imports the modules named in PLUMBLINE_EXTRA_CHECKS, which register checks of their own."""
    import importlib

    for name in filter(None, (x.strip() for x in os.environ.get("PLUMBLINE_EXTRA_CHECKS", "").split(","))):
        importlib.import_module(name)


@dataclass
class Plan:
    config: Config
    variables: dict[str, Any]
    units: list[Unit]
    sources: Callable[[SparkSession], tuple[Source, Source]]
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    log: Log | None = None

    def number(self, name: str, default: int | None) -> int | None:
        value = self.variables.get(name)
        return default if value in (None, "") else int(value)

    def run(self, spark: SparkSession) -> RunResult:
        """All checks; then results are stored and alerts sent, neither of which can fail the run."""
        log = self.log or Log(self.run_id)
        started = datetime.now(timezone.utc)
        load_extra_checks()
        source, target = self.sources(spark)
        log("run.start", tables=len(self.units))
        limit = self.number("table_timeout_sec", None)
        jobs = [(u.table.name, lambda u=u: self.table(spark, u, source, target, log)) for u in self.units]
        results: list[CheckResult] = []
        for (name, _), out in zip(jobs, pooled(jobs, self.number("concurrency", 4), limit, spark, f"plumbline-{self.run_id}"), strict=True):
            if isinstance(out, list):
                results += out
            else:
                results.append(CheckResult(name, "table", FAIL, {"error": str(out)}))
        run = summed(results, run_id=self.run_id, env=self.variables.get("env"), run_label=self.variables.get("run_label"))
        persist_run(spark, self.config.results, run, run_id=self.run_id, env=self.variables.get("env"), run_label=self.variables.get("run_label"), started=started, finished=datetime.now(timezone.utc), log=log)
        dispatch(self.config.routes, run, variables=self.variables, log=log)
        log("run.end", status=run.overall_status)
        return run

    def table(self, spark: SparkSession, unit: Unit, source: Source, target: Source, log: Log) -> list[CheckResult]:
        q = replace(unit.table, source=rendered(unit.table.source, self.variables, unit.span), target=rendered(unit.table.target, self.variables, unit.span))
        limit = self.number("check_timeout_sec", None)
        done: dict[int, CheckResult] = {}
        order = [(i, c) for i, c in enumerate(unit.table.checks)]
        first = [x for x in order if x[1].type in WRITERS]
        for part in (first, [x for x in order if x not in first]):
            jobs = [(f"{unit.table.name}-{i}", lambda c=c: self.check(spark, q, c, source, target)) for i, c in part]
            for (i, c), out in zip(part, pooled(jobs, self.number("concurrency_checks", 1), limit, spark, f"plumbline-{self.run_id}-{unit.table.name}"), strict=True):
                done[i] = out if isinstance(out, CheckResult) else CheckResult(unit.table.name, c.type, FAIL, {"error": f"{type(out).__name__}: {out}"})
                log("check.end", table=unit.table.name, check=c.type, status=done[i].status, **({"error": done[i].details["error"]} if "error" in done[i].details else {}))
        return [done[i] for i in range(len(order))]

    def check(self, spark: SparkSession, table: TableConfig, config: CheckConfig, source: Source, target: Source) -> CheckResult:
        run = CHECKS.get(config.type)
        if run is None:
            return CheckResult(table.name, config.type, SKIP, {"reason": "unknown_check_type"})
        if not enabled(config.type):
            return CheckResult(table.name, config.type, SKIP, {"reason": "disabled"})
        return run(Context(spark, table, config, source, target, self.config.hashing, self.variables, Artifacts(self.config.results.mismatch_csv), self.run_id))


def pooled(jobs: list[tuple[str, Callable[[], Any]]], workers: int | None, limit: float | None, spark: SparkSession, tag: str) -> list[Any]:
    """Results (or exceptions) of the jobs, in order.  A job over its limit is interrupted by its tag and gives a TimeoutError."""
    out: list[Any] = [None] * len(jobs)
    if not jobs:
        return out

    context = spark.sparkContext
    tagged = [f"{tag}-{i}" for i in range(len(jobs))]
    began: dict[int, float] = {}
    clock = time.monotonic

    def one(i: int) -> Any:
        began[i] = clock()
        context.addJobTag(tagged[i])
        context.setInterruptOnCancel(True)
        try:
            return jobs[i][1]()
        finally:
            context.removeJobTag(tagged[i])

    pool = ThreadPoolExecutor(max(1, int(workers or 1)), thread_name_prefix="plumbline")
    pending: dict[Future, int] = {pool.submit(inherited(spark, one), i): i for i in range(len(jobs))}
    try:
        while pending:
            done, _ = wait(pending, timeout=0.2 if limit else None, return_when=FIRST_COMPLETED)
            for f in done:
                i = pending.pop(f)
                out[i] = f.exception() or f.result()
            if limit:
                for f, i in list(pending.items()):
                    if i in began and clock() - began[i] > limit:
                        context.cancelJobsWithTag(tagged[i])
                        out[i] = TimeoutError(f"over {limit:g} seconds")
                        del pending[f]
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return out


def inherited(spark: SparkSession, f: Callable) -> Callable:
    """f with the calling thread's Spark tags, so that interrupting a table interrupts its checks."""
    tags = set(spark.sparkContext.getJobTags())

    def run(*args):
        for t in tags:
            spark.sparkContext.addJobTag(t)
        return f(*args)

    return run


def build(config: Config, variables: dict[str, Any], *, sources: Callable[[SparkSession], tuple[Source, Source]] | None = None, now: datetime | None = None) -> Plan:
    """A unit a table, all in the configured window; connections come from the environment when the plan runs."""
    span = window(config.partitions, now or variables.get("run_timestamp") or datetime.now(timezone.utc))
    c = config.connections
    open_ = sources or (lambda spark: (Source(spark, connection(c.source_env_var), c.source_type), Source(spark, connection(c.target_env_var), c.target_type)))
    return Plan(config, variables, [Unit(t, span) for t in config.tables], open_)
