"""Which reader a connection string asks for."""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import parse_qsl, urlencode, urlparse

#: The schemes of connection strings, and the engine of each.
SCHEMES = {
    "csv": "csv", "file": "csv", "duckdb": "csv", "parquet": "parquet",
    "gs": "gcs_csv", "gcs": "gcs_csv", "s3": "csv", "s3a": "csv", "hdfs": "csv", "viewfs": "csv",
    "postgres": "postgres", "postgresql": "postgres", "pg": "postgres", "bigquery": "bigquery", "bq": "bigquery",
    "oracle": "oracle", "mssql": "mssql", "sqlserver": "mssql", "snowflake": "snowflake",
    "airtable": "airtable", "rest": "rest_api", "rest_api": "rest_api", "http": "rest_api", "https": "rest_api",
    "spark": "spark", "table": "spark", "delta": "spark",
}
#: Engines that plug-ins have registered; their names are schemes too.
PLUGINS: dict[str, Callable] = {}
UNSUPPORTED = {"airtable", "rest_api"}
FILES = {"csv", "parquet", "gcs_csv", "gcs_parquet"}


def engine_of(uri: str, declared: str | None = None) -> str:
    """The declared engine, or that of the scheme; files in object stores go by their extension.

    A driver after + in the scheme is ignored, but parquet and csv there name the format.  A bare path is a file.
    """
    if declared:
        engine = declared.strip().lower()
        engine = {"file": "csv", "duckdb": "csv", "postgresql": "postgres", "pg": "postgres", "bq": "bigquery", "sqlserver": "mssql", "rest": "rest_api"}.get(engine, engine)
    else:
        scheme, plus, driver = (urlparse(uri).scheme.lower() if "://" in uri else "").partition("+")
        path = uri.split("?", 1)[0].lower().rstrip("/")
        parquet = path.endswith((".parquet", ".pq")) or driver == "parquet"
        if not scheme:
            engine = "parquet" if parquet else "csv"
        elif scheme in PLUGINS:
            return scheme
        elif scheme in SCHEMES:
            engine = SCHEMES[scheme]
            if parquet and engine in ("csv", "gcs_csv"):
                engine = "gcs_parquet" if engine == "gcs_csv" else "parquet"
        else:
            raise ValueError(f"unknown scheme in connection {uri.split('@')[-1]!r}")
    if engine in PLUGINS:
        return engine
    if engine in UNSUPPORTED:
        raise NotImplementedError(f"engine {engine!r} is not supported")
    if engine not in set(SCHEMES.values()) | FILES:
        raise ValueError(f"unknown engine {engine!r}")
    return engine


def path_of(uri: str) -> str:
    """A file's path: csv:// and the like are dropped, stores that Spark knows stay."""
    scheme, sep, rest = uri.partition("://")
    if not sep:
        return uri
    base = scheme.lower().partition("+")[0]
    if base in ("csv", "file", "duckdb", "parquet"):
        return rest
    return ("gs" if base == "gcs" else base) + "://" + rest


def jdbc_url(uri: str, engine: str) -> tuple[str, dict[str, str]]:
    """A JDBC address and its options for user, password and driver."""
    u = urlparse(uri)
    database, _, schema = u.path.strip("/").partition("/")
    session = urlencode({"db": database, **({"schema": schema} if schema else {}), **dict(parse_qsl(u.query))})
    port = f":{u.port}" if u.port else ":1433" if engine == "mssql" else ""
    name = u.path.lstrip("/")
    url = {
        "postgres": f"jdbc:postgresql://{u.hostname}{port}/{name}",
        "oracle": f"jdbc:oracle:thin:@//{u.hostname}{port}/{name}",
        "mssql": f"jdbc:sqlserver://{u.hostname}{port};databaseName={name}",
        "snowflake": f"jdbc:snowflake://{u.hostname}{port}/?{session}",
    }[engine]
    options = {k: v for k, v in (("user", u.username), ("password", u.password)) if v}
    return url, options


def bigquery_options(uri: str) -> dict[str, str]:
    """The reader's options: the project of bigquery://project/dataset, else GOOGLE_CLOUD_PROJECT's."""
    u = urlparse(uri)
    project, dataset = u.hostname or os.environ.get("GOOGLE_CLOUD_PROJECT"), u.path.strip("/")
    return {k: v for k, v in (("parentProject", project), ("dataset", dataset)) if v}
