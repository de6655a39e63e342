"""The command line: python -m plumbline.cli --config-file FILE --filetype yaml."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Arguments:
    config_file: str
    filetype: str
    variables: dict[str, Any]
    routes: list[dict[str, Any]] | None
    overrides: dict[str, Any] = field(default_factory=dict)


def pieces(values: list[str] | None) -> list[str]:
    """Items separated by blanks (as the shell splits them) or commas."""
    return [p.strip() for v in values or [] for p in v.split(",") if p.strip()]


def pairs(values: list[str] | None) -> dict[str, str]:
    out = {}
    for item in pieces(values):
        key, sep, value = item.partition("=")
        if not sep or not key.strip():
            raise ValueError(f"not key=value: {item!r}")
        out[key.strip()] = value
    return out


def routes_of(values: list[str] | None) -> list[dict[str, Any]] | None:
    """kind:key=value starts a route; the key=value items that follow belong to it, and addresses without a key to ``to``."""
    routes: list[dict[str, Any]] = []
    for item in pieces(values):
        head, sep, rest = item.partition(":")
        if sep and "=" not in head:
            routes.append({"kind": head})
            item = rest
            if not item:
                continue
        elif not routes:
            if "=" in item:
                raise ValueError(f"an alert begins with its kind: {item!r}")
            routes.append({"kind": item})
            continue
        key, eq, value = item.partition("=")
        if eq:
            routes[-1][key.strip()] = value
        elif "@" in item and routes[-1].get("to"):
            routes[-1]["to"] += f",{item}"
        else:
            routes.append({"kind": item})
    return routes or None


def parse(argv: list[str]) -> Arguments:
    number = lambda name, default: int(v) if (v := os.environ.get(f"PLUMBLINE_{name}")) else default
    p = argparse.ArgumentParser(prog="plumbline", description="Config-driven data-quality and reconciliation checks on Spark.")
    p.add_argument("--config-file", required=True)
    p.add_argument("--filetype", required=True, choices=["yaml", "py"])
    p.add_argument("--vars", nargs="*", help="key=value pairs, separated by blanks or commas")
    p.add_argument("--env")
    p.add_argument("--run_label", "--run-label")
    p.add_argument("--alerts", nargs="*", help="routes in place of the configured ones, such as gchat:webhook=... email:to=...")
    p.add_argument("--concurrency", type=int, default=number("CONCURRENCY", 4))
    p.add_argument("--concurrency_checks", type=int, default=number("CONCURRENCY_CHECKS", 1))
    p.add_argument("--table_timeout_sec", type=int, default=number("TABLE_TIMEOUT", None))
    p.add_argument("--check_timeout_sec", type=int, default=number("CHECK_TIMEOUT", None))
    p.add_argument("--max_rows_preview", type=int, default=number("MAX_ROWS_PREVIEW", 1000))
    a = p.parse_args(argv)
    variables = {**{k: v for k, v in (("env", a.env), ("run_label", a.run_label)) if v}, **pairs(a.vars)}
    names = ("concurrency", "concurrency_checks", "table_timeout_sec", "check_timeout_sec", "max_rows_preview")
    return Arguments(a.config_file, a.filetype, variables, routes_of(a.alerts), {n: getattr(a, n) for n in names})


def main(argv: list[str] | None = None) -> int:
    """0 if no check failed, 1 if any did."""
    from pyspark.sql import SparkSession

    from .plans.config import config_of
    from .plans.loading import load, normalize
    from .plans.planner import build
    from .sinks.render import markdown_table, summarize_run

    args = parse(sys.argv[1:] if argv is None else argv)
    config, variables = normalize(config_of(load(args.config_file, args.filetype, args.variables)), args.variables, routes=args.routes, overrides=args.overrides)
    spark = SparkSession.builder.appName("plumbline").config("spark.scheduler.mode", "FAIR").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = build(config, variables).run(spark)
    print(summarize_run(run, variables=variables))
    print()
    print(markdown_table(run, variables=variables))
    return 1 if run.overall_status == "FAIL" else 0


if __name__ == "__main__":
    sys.exit(main())
