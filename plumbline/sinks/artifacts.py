"""Files of differing rows or ranges: a small CSV, written by the driver, or by Spark where the backend is a store."""

from __future__ import annotations

import csv
import os
import re
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def shaped(rows: Iterable[Any]) -> tuple[list[str], list[dict[str, Any]]]:
    """Header (columns as first seen) and rows: mappings as they are, sequences as column_i, single values as value."""
    out: list[dict[str, Any]] = []
    for r in rows:
        if hasattr(r, "asDict"):
            r = r.asDict()
        if isinstance(r, dict):
            out.append(r)
        elif isinstance(r, (list, tuple)):
            out.append({f"column_{i}": v for i, v in enumerate(r, 1)})
        else:
            out.append({"value": r})
    return list(dict.fromkeys(k for r in out for k in r)), out


def file_name(run_id: str, label: str, now: datetime | None = None) -> str:
    safe = re.sub(r"[^0-9A-Za-z_.-]+", "_", label).strip("_") or "rows"
    return f"{run_id}-{safe}-{(now or datetime.now(timezone.utc)):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}.csv"


class Artifacts:
    """Writes files if its configuration (see MismatchCsv) enables them."""

    def __init__(self, config: Any = None):
        self.config = config

    def write(self, df: DataFrame, label: str, variables: dict[str, Any], run_id: str) -> str | None:
        c = self.config
        if c is None or not c.enabled:
            return None
        name = file_name(run_id, f"{variables.get('run_label') or 'run'}-{label}")
        local = Path(os.environ.get("PLUMBLINE_ARTIFACTS_DIR", "artifacts")) / c.base_path / name
        if c.backend == "local":
            return write_csv(df.toLocalIterator(), local)
        bucket = (c.bucket or "").rstrip("/")
        if bucket and c.backend == "gcs" and "://" not in bucket:
            bucket = f"gs://{bucket}"
        path = f"{bucket}/{c.base_path}/{name}" if bucket else f"{c.base_path}/{name}"
        try:
            df.coalesce(1).write.option("header", True).csv(path)
        except Exception:  # noqa: BLE001  the store is out of reach: the file is kept beside the driver
            return write_csv(df.toLocalIterator(), local)
        return f"{c.public_url_prefix.rstrip('/')}/{c.base_path}/{name}" if c.public_url_prefix else path


def write_csv(rows: Iterable[Any], path: Path) -> str:
    header, out = shaped(rows)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        w = csv.DictWriter(f, header)
        w.writeheader()
        w.writerows(out)
    return str(path)
