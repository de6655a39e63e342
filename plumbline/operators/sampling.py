"""Where counts differ: ranges of an integral id, by chunks or by halving.

Either way each side is scanned twice at most, for the bounds and for the counts, whatever the number of ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_SCHEMA = "range_start long, range_end long, source_count long, target_count long, diff long"
#: Levels of halving that are counted in one scan.
LEVELS = 11


@dataclass(frozen=True)
class Sampling:
    """chunk: consecutive ranges of chunk_size; binary: halving down to max_depth levels."""

    mode: str
    chunk_size: int = 1_000_000
    max_ranges: int = 5
    max_scan_chunks: int = 100
    max_depth: int = 5
    range_start: int | None = None
    range_end: int | None = None

    def __post_init__(self):
        if self.mode not in ("chunk", "binary"):
            raise ValueError(f"unknown sampling mode {self.mode!r}")
        if self.mode == "chunk" and self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive")


@dataclass
class Ranges:
    """The differing ranges as a DataFrame, and whether the scan stopped before the end."""

    df: DataFrame
    truncated: bool
    start: int
    end: int

    def top(self, n: int) -> DataFrame:
        return self.df.orderBy(F.abs("diff").desc(), "range_start").limit(n)


def ids(source: DataFrame, target: DataFrame, id_source: str, id_target: str) -> DataFrame:
    """id and s (1: source, 0: target) of both sides; ids are whole numbers, cut towards zero; others are left out."""
    whole = lambda e: F.coalesce(F.expr(e).try_cast("bigint"), F.expr(e).cast("string").try_cast("double").try_cast("bigint"))
    one = lambda df, e, s: df.select(whole(e).alias("id"), F.lit(s).alias("s"))
    return one(source, id_source, 1).union(one(target, id_target, 0)).where("id is not null")


def bounds(both: DataFrame, sampling: Sampling) -> tuple[int, int] | None:
    lo, hi = sampling.range_start, sampling.range_end
    if lo is None or hi is None:
        row = both.agg(F.min("id"), F.max("id")).first()
        lo, hi = row[0] if lo is None else lo, row[1] if hi is None else hi
    return None if lo is None or hi is None or lo > hi else (int(lo), int(hi))


def _counts(df: DataFrame, key: Column | str) -> DataFrame:
    return df.groupBy(key).agg(F.sum("s").alias("source_count"), F.sum(F.lit(1) - F.col("s")).alias("target_count"))


def chunk_ranges(both: DataFrame, sampling: Sampling) -> Ranges | None:
    found = bounds(both, sampling)
    if found is None:
        return None
    lo, hi = found
    size, most = sampling.chunk_size, max(1, sampling.max_scan_chunks)
    last = min(hi, lo + most * size - 1)
    b = F.floor((F.col("id") - lo) / F.lit(size)) if size >= 1 << 53 else F.expr(f"(id - {lo}L) div {size}L")
    counts = _counts(both.where(F.col("id").between(lo, last)).withColumn("b", b), "b").where("source_count <> target_count")
    start = F.lit(lo) + F.col("b") * size
    df = counts.select(start.cast("long").alias("range_start"), F.least(F.lit(hi), start + size - 1).cast("long").alias("range_end"), "source_count", "target_count", (F.col("source_count") - F.col("target_count")).alias("diff"))
    return Ranges(df, lo + most * size <= hi, lo, hi)


class Tree:
    """Counts of the ranges that halving gives, a few levels a scan."""

    def __init__(self, both: DataFrame):
        self.both = both
        self.known: dict[tuple[int, int], tuple[int, int]] = {}

    def count(self, lo: int, hi: int, levels: int) -> tuple[int, int]:
        if (lo, hi) not in self.known:
            self._scan(lo, hi, max(1, min(levels, LEVELS)))
        return self.known[(lo, hi)]

    def _scan(self, lo: int, hi: int, levels: int) -> None:
        start = F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))

        def halve(r: Column, _: Column) -> Column:
            mid = r["lo"] + F.floor((r["hi"] - r["lo"]) / 2).cast("long") if hi - lo < 1 << 52 else r["lo"] + F.shiftright(r["hi"] - r["lo"], 1)
            left = F.col("id") <= mid
            return F.when(r["lo"] == r["hi"], r).otherwise(F.struct(F.when(left, r["lo"]).otherwise(mid + 1).alias("lo"), F.when(left, mid).otherwise(r["hi"]).alias("hi")))

        leaf = F.aggregate(F.sequence(F.lit(1), F.lit(levels - 1)), start, halve) if levels > 1 else start
        rows = _counts(self.both.where(F.col("id").between(lo, hi)).withColumn("leaf", leaf), "leaf").collect()  # at most 2 ** (levels - 1)
        leaves = {(r["leaf"]["lo"], r["leaf"]["hi"]): (r["source_count"], r["target_count"]) for r in rows}

        def roll(a: int, b: int, level: int) -> tuple[int, int]:
            if level == levels or a == b:
                out = leaves.get((a, b), (0, 0))
            else:
                mid = (a + b) // 2
                x, y = roll(a, mid, level + 1), roll(mid + 1, b, level + 1)
                out = (x[0] + y[0], x[1] + y[1])
            self.known[(a, b)] = out
            return out

        roll(lo, hi, 1)


def binary_ranges(both: DataFrame, sampling: Sampling) -> Ranges | None:
    """Depth first, halves in order: equal counts end a branch, as do max_depth and single ids; visits are limited."""
    found = bounds(both, sampling)
    if found is None:
        return None
    lo, hi = found
    tree, rows, visits, truncated = Tree(both), [], 0, False
    stack = [(lo, hi, 1)]
    while stack:
        a, b, depth = stack.pop()
        if visits >= max(1, sampling.max_scan_chunks):
            truncated = True
            break
        visits += 1
        s, t = tree.count(a, b, sampling.max_depth - depth + 1)
        if s == t:
            continue
        if depth >= sampling.max_depth or a == b:
            rows.append((a, b, s, t, s - t))
            continue
        mid = (a + b) // 2
        stack += [(mid + 1, b, depth + 1), (a, mid, depth + 1)]
    spark: SparkSession = both.sparkSession
    return Ranges(spark.createDataFrame(rows, RANGE_SCHEMA), truncated, lo, hi)


def mismatch_ranges(source: DataFrame, target: DataFrame, id_source: str, id_target: str, sampling: Sampling) -> Ranges | None:
    """Ranges of ids whose row counts differ: range_start, range_end, source_count, target_count, diff; None without ids."""
    both = ids(source, target, id_source, id_target)
    return chunk_ranges(both, sampling) if sampling.mode == "chunk" else binary_ranges(both, sampling)
