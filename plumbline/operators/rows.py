"""Row-level comparison: differing hashes, missing and extra keys, differing cells."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.compare import equal_cell, kind_of
from ..functions.hashing import HashPolicy, row_hash


def hash_diff_rows(source: DataFrame, target: DataFrame, columns: list[str], policy: HashPolicy | None = None) -> DataFrame:
    """h, in_source, in_target of every distinct row hash: sets, so duplicates don't count.

    Both sides go through one aggregation by hash, which also removes duplicates before the shuffle.
    """
    s = source.select(row_hash(source, columns, policy).alias("h"), F.lit(True).alias("s"))
    t = target.select(row_hash(target, columns, policy).alias("h"), F.lit(False).alias("s"))
    return s.union(t).groupBy("h").agg(F.bool_or("s").alias("in_source"), F.bool_or(~F.col("s")).alias("in_target"))


def hash_diff(source: DataFrame, target: DataFrame, columns: list[str], policy: HashPolicy | None = None) -> DataFrame:
    """One row: missing_count (hashes of the source alone), extra_count, status."""
    rows = hash_diff_rows(source, target, columns, policy)
    out = rows.agg(F.count_if(~F.col("in_target")).alias("missing_count"), F.count_if(~F.col("in_source")).alias("extra_count"))
    return out.withColumn("status", F.when((F.col("missing_count") == 0) & (F.col("extra_count") == 0), "PASS").otherwise("FAIL"))


@dataclass(frozen=True)
class Tolerance:
    abs: float | None = None
    pct: float | None = None


class RowDiff:
    """Full outer join of two aligned sides on their keys; NULL keys match each other and duplicate keys multiply.

    ``source`` and ``target`` hold the key columns (same names) and the compared columns.  A column's tolerance replaces
    the default wholly.  ``order`` names further columns of both sides, which order what missing(), extra() and cells()
    give; DESC may follow a name.  Rows that agree leave the plan right after the join, so whoever persists ``differing``
    gets the summary and all listings from one join.
    """

    def __init__(self, source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], default: Tolerance | None = None, tolerances: dict[str, Tolerance] | None = None, order: list[str] | None = None):
        if not keys:
            raise ValueError("join keys are required")
        self.keys, self.columns = keys, columns
        by = [o.split()[0] for o in order or []]
        self.order = [F.col(f"by{i}").desc() if o.split()[1:] and o.split()[1].lower() == "desc" else F.col(f"by{i}").asc() for i, o in enumerate(order or [])]
        s = source.select(*[F.col(k).alias(f"s_{k}") for k in keys], *[F.col(c).alias(f"s__{c}") for c in columns], *[F.col(o).alias(f"s_by{i}") for i, o in enumerate(by)], F.lit(True).alias("in_source"))
        t = target.select(*[F.col(k).alias(f"t_{k}") for k in keys], *[F.col(c).alias(f"t__{c}") for c in columns], *[F.col(o).alias(f"t_by{i}") for i, o in enumerate(by)], F.lit(True).alias("in_target"))
        on = reduce(lambda a, b: a & b, [F.col(f"s_{k}").eqNullSafe(F.col(f"t_{k}")) for k in keys])
        joined = s.join(t, on, "full_outer")
        equals = []
        for c in columns:
            tol = (tolerances or {}).get(c, default or Tolerance())
            kinds = (kind_of(source.schema[c].dataType), kind_of(target.schema[c].dataType))
            equals.append(equal_cell(F.col(f"s__{c}"), F.col(f"t__{c}"), kinds, tol.abs, tol.pct))
        both = F.col("in_source").isNotNull() & F.col("in_target").isNotNull()
        cells = [F.when(~e, F.struct(F.lit(c).alias("column"), F.col(f"s__{c}").cast("string").alias("source"), F.col(f"t__{c}").cast("string").alias("target"))) for c, e in zip(columns, equals, strict=True)]
        cells = F.array_compact(F.array(*cells)) if cells else F.array()
        key_cols = [F.when(F.col("in_source").isNotNull(), F.col(f"s_{k}")).otherwise(F.col(f"t_{k}")).alias(k) for k in keys]
        by_cols = [F.when(F.col("in_source").isNotNull(), F.col(f"s_by{i}")).otherwise(F.col(f"t_by{i}")).alias(f"by{i}") for i in range(len(by))]
        self.joined = joined.select(*key_cols, *by_cols, F.col("in_source").isNotNull().alias("in_source"), F.col("in_target").isNotNull().alias("in_target"), F.when(both, cells).alias("cells"))
        self.differing = self.joined.where(~F.col("in_source") | ~F.col("in_target") | (F.size("cells") > 0))

    def _listed(self, rows: DataFrame, *columns) -> DataFrame:
        return (rows.orderBy(*self.order, *self.keys) if self.order else rows).select(*self.keys, *columns)

    def missing(self) -> DataFrame:
        return self._listed(self.differing.where(~F.col("in_target")))

    def extra(self) -> DataFrame:
        return self._listed(self.differing.where(~F.col("in_source")))

    def cells(self) -> DataFrame:
        """A row a differing cell: the keys, column, and both values as text."""
        rows = self.differing.where("in_source and in_target")
        return self._listed(rows.withColumn("x", F.explode("cells")), "x.*")

    def summary(self) -> DataFrame:
        """One row: missing, extra, rows with a differing cell, differing cells, status."""
        differing = F.col("in_source") & F.col("in_target") & (F.size("cells") > 0)
        out = self.differing.agg(
            F.count_if(~F.col("in_target")).alias("missing_count_on_target"), F.count_if(~F.col("in_source")).alias("extra_count_on_target"),
            F.count_if(differing).alias("mismatch_rows"), F.coalesce(F.sum(F.when(differing, F.size("cells"))), F.lit(0)).alias("mismatch_total"),
        )
        clean = (F.col("missing_count_on_target") == 0) & (F.col("extra_count_on_target") == 0) & (F.col("mismatch_total") == 0)
        return out.withColumn("status", F.when(clean, "PASS").otherwise("FAIL"))
