"""Appends to stored tables: runs, check results, statistics."""

from __future__ import annotations

from datetime import datetime
from typing import TYPE_CHECKING, Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from ..plans.results import RunResult


def append(df: DataFrame, storage: Any, partition_by: str | None = None) -> None:
    if storage.backend == "bigquery":
        project = {"parentProject": storage.project} if storage.project else {}
        df.write.mode("append").format("bigquery").options(writeMethod="direct", **project).save(storage.table)
        return
    writer = df.write.mode("append")
    writer = writer.partitionBy(partition_by) if partition_by else writer
    if storage.backend == "parquet":
        writer.parquet(storage.table)
    elif storage.backend == "table":
        writer.saveAsTable(storage.table)
    else:
        raise ValueError(f"unknown storage backend {storage.backend!r}")


def read_stats(spark: SparkSession, storage: Any) -> DataFrame | None:
    """Stored statistics, or None if there are none yet.  Files are partitioned by table_name, so a filter on it prunes."""
    from ..plans.results import STATS_SCHEMA

    try:
        if storage.backend == "table":
            return spark.table(storage.table)
        if storage.backend == "bigquery":
            return spark.read.format("bigquery").load(storage.table)
        return spark.read.schema(STATS_SCHEMA.replace(" NOT NULL", "")).parquet(storage.table)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            return None
        raise


def persist_run(spark: SparkSession, storage: Any, run: RunResult, *, run_id: str, env: str | None, run_label: str | None, started: datetime, finished: datetime, log: Any) -> None:
    """Stores the run and its checks where configured; a failure is logged."""
    from ..plans.results import CHECKS_SCHEMA, RUNS_SCHEMA, check_row, frame, run_row

    parts = (
        (storage.runs, RUNS_SCHEMA, lambda: [run_row(run, run_id=run_id, env=env, run_label=run_label, started=started, finished=finished)]),
        (storage.checks, CHECKS_SCHEMA, lambda: [check_row(c, run_id=run_id, created=finished) for c in run.checks]),
    )
    for where, schema, rows in parts:
        if where is not None and (found := rows()):
            try:
                append(frame(spark, found, schema), where)
            except Exception as e:  # noqa: BLE001  results are reported even if they can't be stored
                log("results.persistence.error", level="WARNING", table=where.table, error=str(e))
