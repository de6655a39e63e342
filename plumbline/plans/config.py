"""The configuration: from nested mappings to checked objects, with names, defaults and errors in one place."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from ..functions.hashing import HashPolicy
from ..functions.severity import AdaptiveRule, SeverityRule
from ..operators.sampling import Sampling
from ..operators.stats import Metric, StatsWindow
from ..sources.sides import Query

STORAGE_BACKENDS = ("parquet", "table", "bigquery")
PARTITION_MODES = ("none", "rolling_days", "rolling_hours", "range")


class ConfigError(ValueError):
    pass


def take(cls, raw: dict | None, where: str, **renamed: str):
    """An object of a dataclass from a mapping; unknown keys are errors that name their place."""
    raw = {renamed.get(k, k): v for k, v in (raw or {}).items()}
    known = {f.name for f in fields(cls)}
    if unknown := sorted(map(str, set(raw) - known)):
        raise ConfigError(f"{where}: unknown {', '.join(unknown)}")
    try:
        return cls(**raw)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{where}: {e}") from e


@dataclass(frozen=True)
class Connections:
    source_env_var: str
    target_env_var: str
    source_type: str | None = None
    target_type: str | None = None


@dataclass(frozen=True)
class Partitions:
    """mode none, rolling_days or rolling_hours (the last ``window`` of them), or range (start to end)."""

    mode: str = "none"
    window: int | None = None
    start: str | None = None
    end: str | None = None

    def __post_init__(self):
        if self.mode not in PARTITION_MODES:
            raise ConfigError(f"unknown partition mode {self.mode!r}")
        if self.mode.startswith("rolling") and not self.window:
            raise ConfigError(f"{self.mode} needs a window")
        if self.mode == "range" and not (self.start and self.end):
            raise ConfigError("range needs start and end")


@dataclass(frozen=True)
class Storage:
    """Where rows are kept: backend parquet (table is a path), table (a catalogue table) or bigquery (with a project)."""

    table: str
    backend: str = "parquet"
    project: str | None = None

    def __post_init__(self):
        if self.backend not in STORAGE_BACKENDS:
            raise ConfigError(f"unknown storage backend {self.backend!r}; one of {', '.join(STORAGE_BACKENDS)}")


@dataclass(frozen=True)
class MismatchCsv:
    """Files of differing ranges: backend local, gcs (a bucket's name or address) or hadoop (any path that Spark writes to)."""

    enabled: bool = False
    backend: str = "local"
    bucket: str | None = None
    base_path: str = "mismatch_ranges"
    public_url_prefix: str | None = None


@dataclass(frozen=True)
class ResultsStorage:
    mismatch_csv: MismatchCsv = MismatchCsv()
    runs: Storage | None = None
    checks: Storage | None = None


@dataclass
class CheckConfig:
    """A check: its type and options.  Which options a type takes is the check's own affair."""

    type: str
    options: dict[str, Any] = field(default_factory=dict)

    def get(self, *names: str, default: Any = None) -> Any:
        return next((self.options[n] for n in names if self.options.get(n) is not None), default)

    def need(self, *names: str) -> Any:
        if (value := self.get(*names)) is None:
            raise ConfigError(f"{self.type}: {' or '.join(names)} is required")
        return value

    def tolerances(self) -> dict[str, float | None]:
        return {"tolerance_abs": self.get("tolerance_abs"), "tolerance_pct": self.get("tolerance_pct")}

    def sampling(self, rule: dict | None = None) -> Sampling | None:
        raw = (rule or {}).get("mismatch_sampling") or self.get("mismatch_sampling")
        return take(Sampling, raw, f"{self.type}.mismatch_sampling") if raw else None

    def ids(self, rule: dict | None = None) -> tuple[str, str] | None:
        r = {**self.options, **(rule or {})}
        s, t = r.get("id_column_source") or r.get("id_column"), r.get("id_column_target") or r.get("id_column")
        return (s, t) if s and t else None

    def severity_rules(self) -> list[SeverityRule]:
        return [take(SeverityRule, r, f"{self.type}.severity_rules") for r in self.get("severity_rules", default=[])]

    def adaptive_rules(self) -> list[AdaptiveRule]:
        return [take(AdaptiveRule, r, f"{self.type}.adaptive_thresholds") for r in self.get("adaptive_thresholds", default=[])]

    def metrics(self) -> list[Metric]:
        return [take(Metric, {k: v for k, v in m.items() if v is not None}, f"{self.type}.metrics") for m in self.get("metrics", default=[])]

    def windows(self) -> list[StatsWindow]:
        return [take(StatsWindow, w, f"{self.type}.compare_on") for w in self.get("compare_on", default=[])]


@dataclass
class TableConfig:
    name: str
    source: Query
    target: Query
    column_map: dict[str, Any] = field(default_factory=dict)
    checks: list[CheckConfig] = field(default_factory=list)


@dataclass
class Config:
    connections: Connections
    tables: list[TableConfig]
    hashing: HashPolicy = HashPolicy()
    partitions: Partitions = Partitions()
    results: ResultsStorage = ResultsStorage()
    routes: list[dict[str, Any]] = field(default_factory=list)


def check_config(raw: dict, where: str) -> CheckConfig:
    """YAML reads a bare ``on`` as true; both stand for the side."""
    options = {("on" if k is True else k): v for k, v in raw.items()}
    rules = options.get("rules")
    if isinstance(rules, list):
        options["rules"] = [{("on" if k is True else k): v for k, v in r.items()} if isinstance(r, dict) else r for r in rules]
    kind = options.pop("type", None)
    if not kind:
        raise ConfigError(f"{where}: type is required")
    a, b = options.get("include_source"), options.get("include_target")
    if (a or b) and len(a or []) != len(b or []):
        raise ConfigError(f"{where}: include_source and include_target differ in length")
    return CheckConfig(str(kind), options)


def _switched(raw: dict | None, where: str) -> Storage | None:
    """A store that is written to only if enabled is true."""
    raw = dict(raw or {})
    return take(Storage, raw, where) if raw.pop("enabled", False) else None


def config_of(raw: dict) -> Config:
    known = {"connections", "tables", "defaults", "results_storage", "planning", "alerts"}
    if unknown := sorted(map(str, set(raw) - known)):
        raise ConfigError(f"configuration: unknown {', '.join(unknown)}")
    for part in ("connections", "tables"):
        if raw.get(part) is None:
            raise ConfigError(f"configuration: {part} is required")
    tables, names = [], set()
    for i, t in enumerate(raw["tables"]):
        where = f"tables[{i}]"
        if not t.get("name"):
            raise ConfigError(f"{where}: name is required")
        side = lambda s, w=where, t=t: take(Query, t.get(s), f"{w}.{s}")
        if t["name"] in names:
            raise ConfigError(f"{where}: the name {t['name']!r} is taken")
        names.add(t["name"])
        tables.append(TableConfig(t["name"], side("source"), side("target"), t.get("column_map") or {}, [check_config(c, f"{where}.checks[{j}]") for j, c in enumerate(t.get("checks") or [])]))
    defaults, storage = raw.get("defaults") or {}, raw.get("results_storage") or {}
    kept = ResultsStorage(
        take(MismatchCsv, storage.get("mismatch_csv"), "results_storage.mismatch_csv"),
        *(_switched(storage.get(k), f"results_storage.{k}") for k in ("runs", "checks")),
    )
    partitions = take(Partitions, (raw.get("planning") or {}).get("partitions"), "planning.partitions")
    return Config(take(Connections, raw["connections"], "connections"), tables, take(HashPolicy, defaults.get("hashing"), "defaults.hashing"), partitions, kept, list((raw.get("alerts") or {}).get("routes") or []))
