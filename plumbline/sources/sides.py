"""The two sides of a check as lazy DataFrames, and how their columns are aligned."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .uri import FILES, PLUGINS, bigquery_options, engine_of, jdbc_url, path_of


@dataclass(frozen=True)
class Query:
    """What a side reads: query goes before table and select; filters are equalities (a list: any of its members).

    order_by, one expression or a list, orders previews of the side's rows.
    """

    table: str | None = None
    select: str | None = None
    query: str | None = None
    order_by: str | list | None = None
    filters: dict = field(default_factory=dict)


def sanitize(name: str) -> str:
    """A name that every engine takes as a column alias."""
    out = re.sub(r"[^0-9A-Za-z]", "_", name)
    return out if re.match(r"[A-Za-z_]", out) else f"c_{out}"


def split_list(select: str) -> list[str]:
    """Top-level comma-separated expressions."""
    out, depth, quote, start = [], 0, "", 0
    for i, ch in enumerate(select):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == "," and not depth:
            out.append(select[start:i].strip())
            start = i + 1
    return [x for x in [*out, select[start:].strip()] if x]


def ordering(order_by: str | list | None) -> list[Column]:
    """Sort columns of SQL expressions, which may end in ASC or DESC."""
    out = []
    for text in split_list(order_by) if isinstance(order_by, str) else order_by or []:
        m = re.fullmatch(r"(?is)(.*?)(?:\s+(asc|desc))?\s*", text)
        out.append(F.expr(m[1]).desc() if (m[2] or "").lower() == "desc" else F.expr(m[1]).asc())
    return out


def connector(engine: str):
    """Registers a class of connections under an engine's name, which is its scheme too.

    It is made with (spark, uri, options) and has table(name) and sql(query), both giving DataFrames.
    """

    def add(cls):
        PLUGINS[engine] = cls
        return cls

    return add


class Source:
    """A connection: reads tables, files and queries as DataFrames.

    Files are read by Spark's own readers, with pruning and pushdown; databases by JDBC with the whole query pushed down.
    """

    def __init__(self, spark: SparkSession, uri: str, declared: str | None = None, options: dict[str, str] | None = None):
        self.spark, self.uri, self.engine, self.options = spark, uri, engine_of(uri, declared), options or {}
        self.plugin = PLUGINS[self.engine](spark, uri, self.options) if self.engine in PLUGINS else None

    def table(self, name: str | None) -> DataFrame:
        if self.plugin is not None:
            return self.plugin.table(name)
        if self.engine in FILES:
            path = path_of(name) if name and ("/" in name or name.lower().endswith((".csv", ".parquet"))) else path_of(self.uri)
            if self.engine.endswith("parquet") or path.lower().endswith((".parquet", ".pq")):
                return self.spark.read.options(**self.options).parquet(path)
            return self.spark.read.options(header=True, inferSchema=True, **self.options).csv(path)
        if name is None:
            raise ValueError("a table or a query is required")
        return self.spark.table(name) if self.engine == "spark" else self._jdbc(dbtable=name)

    def _jdbc(self, **what: str) -> DataFrame:
        if self.engine == "bigquery":
            what = {"table": what["dbtable"]} if "dbtable" in what else {"query": what["query"], "viewsEnabled": "true"}
            return self.spark.read.format("bigquery").options(**bigquery_options(self.uri), **self.options, **what).load()
        url, login = jdbc_url(self.uri, self.engine)
        return self.spark.read.format("jdbc").options(url=url, **login, **self.options, **what).load()

    def sql(self, query: str) -> DataFrame:
        """A query, verbatim; for files, the connection's file is the view ``source_file``."""
        if self.plugin is not None:
            return self.plugin.sql(query)
        if self.engine in FILES or self.engine == "spark":
            if self.engine in FILES and re.search(r"\bsource_file\b", query):
                self.table(None).createOrReplaceTempView("source_file")
            return self.spark.sql(query)
        return self._jdbc(query=query)

    def read(self, query: Query) -> DataFrame:
        df = self.sql(query.query) if query.query else self.table(query.table)
        if not query.query and query.select and query.select.strip() != "*":
            df = df.selectExpr(*split_list(query.select))
        return filtered(df, query.filters)


def filtered(df: DataFrame, filters: dict) -> DataFrame:
    """Rows that equal every filter; None asks for NULL."""
    tests: list[Column] = []
    for name, value in (filters or {}).items():
        c = F.col(name)
        if isinstance(value, (list, tuple, set)):
            members = [v for v in value if v is not None]
            tests.append(c.isin(members) | (c.isNull() if None in value else F.lit(False)))
        else:
            tests.append(c.isNull() if value is None else c == value)
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


@dataclass(frozen=True)
class Alignment:
    """Canonical names, and each side's expression for them."""

    names: list[str]
    source: list[str]
    target: list[str]

    def apply(self, source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
        pick = lambda df, exprs: df.select(*[F.expr(e).alias(n) for e, n in zip(exprs, self.names, strict=True)])
        return pick(source, self.source), pick(target, self.target)


def align(*, include_map: dict | None = None, include: list[str] | None = None, include_source: list[str] | None = None, include_target: list[str] | None = None, column_map: dict | None = None, exclude: list[str] | None = None) -> Alignment:
    """Which columns are compared: include_map, else include through column_map, else paired lists, else include itself.

    Maps give {name: {source: expression, target: expression}}; a plain string stands for the target's expression.
    """

    def sides(name: str, pair) -> tuple[str, str]:
        return (pair["source"], pair["target"]) if isinstance(pair, dict) else (name, pair)

    if include_map:
        found = [(n, *sides(n, p)) for n, p in include_map.items()]
    elif include and column_map:
        if missing := [n for n in include if n not in column_map]:
            raise ValueError(f"not in column_map: {', '.join(missing)}")
        found = [(n, *sides(n, column_map[n])) for n in include]
    elif include_source or include_target:
        if len(include_source or []) != len(include_target or []):
            raise ValueError("include_source and include_target differ in length")
        found = [(s, s, t) for s, t in zip(include_source, include_target, strict=True)]
    elif include:
        found = [(n, n, n) for n in include]
    else:
        raise ValueError("include_map, include, or include_source with include_target is required")
    found = [(sanitize(n), s, t) for n, s, t in found if n not in set(exclude or [])]
    if len({n for n, _, _ in found}) != len(found):
        raise ValueError("two columns have the same name after alignment")
    return Alignment([n for n, _, _ in found], [s for _, s, _ in found], [t for _, _, t in found])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The last row of each key by descending order, without keys whose last row meets the ``deleted`` predicate."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
    return last.where(~F.coalesce(F.expr(deleted), F.lit(False))) if deleted else last
