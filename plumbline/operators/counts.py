"""Row counts, aggregates and group aggregates of two sides.

Each side is aggregated once, all rules together; the two small results are put under each other and aggregated again by
rule and group, which pairs the sides without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compare import equal_aggregate, equal_group, kind_of

METHODS = ("count", "distinct_count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Rule:
    """An aggregate of a column (or expression) of each side; count takes * too."""

    method: str
    source: str = "*"
    target: str = "*"
    tolerance_abs: float | None = None
    tolerance_pct: float | None = None

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; one of {', '.join(METHODS)}")
        if self.method != "count" and "*" in (self.source, self.target):
            raise ValueError(f"{self.method} needs a column")

    def aggregate(self, side: str) -> Column:
        name = self.source if side == "source" else self.target
        if self.method == "count":
            return F.count(F.lit(1)) if name == "*" else F.count(F.expr(name))
        return {"distinct_count": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.method](F.expr(name))


def row_count(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: source_count, target_count, status (PASS if equal)."""
    both = source.select(F.lit(1).alias("s")).union(target.select(F.lit(0).alias("s")))
    counts = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("source_count"), F.count(F.lit(1)).alias("n"))
    return counts.select("source_count", (F.col("n") - F.col("source_count")).alias("target_count")).withColumn("status", F.when(F.col("source_count") == F.col("target_count"), "PASS").otherwise("FAIL"))


def _long(df: DataFrame, rules: list[Rule], side: str, keys: list[Column]) -> tuple[DataFrame, list[str]]:
    """Keys, rule_idx, side, number, time, text of each rule; every distinct count is an aggregation of its own."""
    parts, kinds = [], [""] * len(rules)
    plain = [i for i, r in enumerate(rules) if r.method != "distinct_count"]
    distinct = [[i] for i, r in enumerate(rules) if r.method == "distinct_count"]
    groups = [plain + distinct[0]] if len(distinct) == 1 else [plain, *distinct]
    for group in filter(None, groups):
        done = df.groupBy(*keys).agg(*[rules[i].aggregate(side).alias(f"r{i}") for i in group])
        cells = []
        for i in group:
            c, kind = F.col(f"r{i}"), kind_of(done.schema[f"r{i}"].dataType)
            kinds[i] = "text" if kind == "other" else kind
            none = lambda t: F.lit(None).cast(t)
            cells.append(F.struct(F.lit(i).alias("rule_idx"), (c.cast("double") if kind == "number" else none("double")).alias("number"), (c.cast("timestamp_ntz") if kind == "time" else none("timestamp_ntz")).alias("time"), (c.cast("string") if kind in ("text", "other") else none("string")).alias("text")))
        names = [n for n in done.columns if n not in {f"r{i}" for i in group}]
        parts.append(done.select(*names, F.explode(F.array(*cells)).alias("x")).select(*names, "x.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("side", F.lit(side)), kinds


def _paired(source: DataFrame, target: DataFrame, rules: list[Rule], s_keys: list[Column], t_keys: list[Column]) -> tuple[DataFrame, list[str], list[str]]:
    s, s_kinds = _long(source, rules, "source", s_keys)
    t, t_kinds = _long(target, rules, "target", t_keys)
    keys = s.columns[: len(s_keys)]
    both = s.union(t.select(*[F.col(c).alias(n) for c, n in zip(t.columns, s.columns, strict=True)]))
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    cols = [of(side, c).alias(f"{side[0]}_{c}") for side in ("source", "target") for c in ("number", "time", "text")]
    present = [F.max(F.when(F.col("side") == side, True)).isNotNull().alias(f"in_{side}") for side in ("source", "target")]
    return both.groupBy(*keys, "rule_idx").agg(*cols, *present), s_kinds, t_kinds


def _by_rule(rules: list[Rule], value) -> Column:
    out = None
    for i, r in enumerate(rules):
        out = F.when(F.col("rule_idx") == i, value(i, r)) if out is None else out.when(F.col("rule_idx") == i, value(i, r))
    return out


def _shown(side: str) -> Column:
    return F.coalesce(F.col(f"{side}_number").cast("string"), F.col(f"{side}_time").cast("string"), F.col(f"{side}_text"))


def aggregations(source: DataFrame, target: DataFrame, rules: list[Rule]) -> DataFrame:
    """A row a rule: rule_idx, method, source and target (numbers), source_text and target_text (any value), pass."""
    if not rules:
        raise ValueError("aggregations needs rules")
    both, s_kinds, t_kinds = _paired(source, target, rules, [], [])

    def equal(i: int, r: Rule) -> Column:
        kind = s_kinds[i] if s_kinds[i] == t_kinds[i] else "text"
        if kind == "text":
            return equal_aggregate(_shown("s"), _shown("t"), "text")
        return equal_aggregate(F.col(f"s_{kind}"), F.col(f"t_{kind}"), kind, r.tolerance_abs, r.tolerance_pct)

    return both.select("rule_idx", _by_rule(rules, lambda i, r: F.lit(r.method)).alias("method"), F.col("s_number").alias("source"), F.col("t_number").alias("target"), _shown("s").alias("source_text"), _shown("t").alias("target_text"), _by_rule(rules, equal).alias("pass"))


def group_aggregations(source: DataFrame, target: DataFrame, rules: list[Rule] | None, key_source: str, key_target: str) -> DataFrame:
    """A row a group and rule: p, rule_idx, method, source, target, pass.  A group of one side alone never passes."""
    rules = rules or [Rule("count")]
    both, _, _ = _paired(source, target, rules, [F.expr(key_source).alias("p")], [F.expr(key_target).alias("p")])
    equal = lambda i, r: F.col("in_source") & F.col("in_target") & equal_group(F.col("s_number"), F.col("t_number"), r.tolerance_abs, r.tolerance_pct)
    timed = F.coalesce(F.col("s_time").cast("string"), F.col("s_text")).eqNullSafe(F.coalesce(F.col("t_time").cast("string"), F.col("t_text")))
    shown = lambda side: F.col(f"{side}_number")
    numeric = F.coalesce(F.col("s_number"), F.col("t_number")).isNotNull()
    ok = F.when(numeric, _by_rule(rules, equal)).otherwise(F.col("in_source") & F.col("in_target") & timed)
    return both.select("p", "rule_idx", _by_rule(rules, lambda i, r: F.lit(r.method)).alias("method"), shown("s").alias("source"), shown("t").alias("target"), ok.alias("pass"))


def partitions(source: DataFrame, target: DataFrame, key_source: str, key_target: str, method: str = "count", column: str = "*") -> DataFrame:
    """group_aggregations with one rule and exact equality."""
    return group_aggregations(source, target, [Rule(method, column, column)], key_source, key_target)


def differing(groups: DataFrame, top_n: int = 50) -> DataFrame:
    """The first groups, in key order, that don't pass."""
    return groups.where(~F.col("pass")).orderBy(F.col("p").asc_nulls_first(), "rule_idx").limit(top_n)
