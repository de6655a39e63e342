"""Configuration files, variables, templates and partition windows."""

from __future__ import annotations

import importlib.util
import os
import re
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from pathlib import Path
from typing import Any

from ..sources.sides import Query
from .config import Config, ConfigError, Partitions

_ENV = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")
_SLOT = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")


def interpolate(value: Any, env: dict[str, str] | None = None) -> Any:
    """${NAME} in all strings becomes the environment's value; unknown names stay."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return _ENV.sub(lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: interpolate(v, env) for k, v in value.items()}
    return [interpolate(v, env) for v in value] if isinstance(value, list) else value


def resolve(path: str, filetype: str) -> Path:
    """The file itself, or a bare name under config/<filetype>/."""
    found = Path(path)
    suffix = ".py" if filetype == "py" else ".yaml"
    for p in (found, found.with_suffix(suffix), Path("config") / filetype / found.name, (Path("config") / filetype / found.name).with_suffix(suffix)):
        if p.is_file():
            return p
    raise ConfigError(f"no configuration file {path!r}")


def load(path: str, filetype: str = "yaml", variables: dict[str, Any] | None = None) -> dict:
    """The raw mapping of a YAML file, or of a Python file's build(variables) or CONFIG."""
    file = resolve(path, filetype)
    if filetype == "yaml":
        import yaml

        raw = yaml.safe_load(file.read_text())
    else:
        spec = importlib.util.spec_from_file_location(f"plumbline_config_{file.stem}", file)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        raw = module.build(variables or {}) if hasattr(module, "build") else getattr(module, "CONFIG", None)
    if not isinstance(raw, dict):
        raise ConfigError(f"{file} holds no mapping")
    return interpolate(raw)


def coerce(value: Any) -> Any:
    """Text of truth values, null and numbers as such; digits with a leading zero stay text."""
    if not isinstance(value, str):
        return value
    text = value.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text.lower() in ("null", "none"):
        return None
    if re.fullmatch(r"[+-]?(0|[1-9][0-9]*)", text):
        return int(text)
    if re.fullmatch(r"[+-]?(0|[1-9][0-9]*)?\.[0-9]+([eE][+-]?[0-9]+)?|[+-]?(0|[1-9][0-9]*)(\.[0-9]*)?([eE][+-]?[0-9]+)", text):
        return float(text)
    return value


def normalize(config: Config, variables: dict[str, Any], *, routes: list[dict] | None = None, overrides: dict[str, Any] | None = None, now: datetime | None = None) -> tuple[Config, dict[str, Any]]:
    """Typed variables with run_timestamp (naive UTC); overrides win, and routes replace the configured alerts."""
    out = {k: coerce(v) for k, v in variables.items()}
    out |= {k: v for k, v in (overrides or {}).items() if v is not None}
    out.setdefault("run_timestamp", (now or datetime.now(timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None))
    return (replace(config, routes=routes) if routes is not None else config), out


def render(text: str | None, context: dict[str, Any]) -> str | None:
    """{{ name }} becomes the variable's value; an unknown name is an error."""
    if not text or "{{" not in text:
        return text

    def value(m: re.Match) -> str:
        if m[1] not in context:
            raise ConfigError(f"template: unknown variable {m[1]!r}")
        return "" if context[m[1]] is None else str(context[m[1]])

    return _SLOT.sub(value, text)


def window(partitions: Partitions, now: datetime) -> tuple[datetime, datetime]:
    """The one window of a run, in UTC: rolling back from now, the given range, or today so far."""
    now = now.replace(tzinfo=timezone.utc) if now.tzinfo is None else now.astimezone(timezone.utc)
    if partitions.mode == "rolling_days":
        return now - timedelta(days=int(partitions.window)), now
    if partitions.mode == "rolling_hours":
        return now - timedelta(hours=int(partitions.window)), now
    if partitions.mode == "range":
        times = [datetime.fromisoformat(str(x).replace("Z", "+00:00")) for x in (partitions.start, partitions.end)]
        return tuple(t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc) for t in times)
    return now.replace(hour=0, minute=0, second=0, microsecond=0), now


def rendered(query: Query, variables: dict[str, Any], span: tuple[datetime, datetime]) -> Query:
    context = {"env": None, "run_label": None, **variables, "partition_start_iso": span[0].isoformat(), "partition_end_iso": span[1].isoformat()}
    return replace(query, table=render(query.table, context), select=render(query.select, context), query=render(query.query, context))
