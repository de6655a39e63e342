"""Nearest neighbours by inner product: collision-counting hashing with virtual rehashing.

Vectors are scaled by the largest norm and given one more component so that all have norm 1; the nearest by distance are
then the nearest by inner product.  A shard of rows is projected on random lines, and each line's values are kept sorted.
A query's windows on all lines are centred at its own projections and widened together, step by step (virtual rehashing),
while each row's collisions, the windows it lies in, are counted.  Rows with enough collisions are candidates; the windows
grow until there are enough candidates, all of which are verified exactly.  Counting works on bit sets of rows, 64 at once.

Rows are dealt to shards of a bounded size and queries to blocks of a bounded size; each pair of them is one group.  Every
row is indexed.  The best of each pair are merged by a ranking per query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD_ROWS, QUERY_ROWS = 8192, 4096
LINES = 128
#: The steps that a line's sorted values are kept by, a window's first half-width, and by how much windows grow in a step.
GRID, HALF, GROW = 1 / 16, 1 / 4, 1.06
#: Collisions that make a candidate, as a share of the lines.
THRESHOLD = 0.63
#: Candidates that end the widening: ten for each result wanted, and this share of the shard's rows.
ENOUGH = 0.2
#: Queries that are counted at a time; what they need fits a core's cache.
AT_ONCE = 64


def added(sets) -> list[np.ndarray]:
    """How many of the bit sets hold each row: the binary digits of the counts, lowest first, as bit sets (a tree of adders)."""
    held: list[list[np.ndarray]] = [[]]

    def put(x: np.ndarray, digit: int) -> None:
        if digit == len(held):
            held.append([])
        held[digit].append(x)

    for x in sets:
        put(x, 0)
        digit = 0
        while len(held[digit]) == 3:
            a, b, c = held[digit]
            u = a ^ b
            held[digit] = [u ^ c]
            put((a & b) | (u & c), digit + 1)
            digit += 1
    digit = 0
    while digit < len(held):
        if len(held[digit]) == 2:
            a, b = held[digit]
            held[digit] = [a ^ b]
            put(a & b, digit + 1)
        digit += 1
        if digit < len(held) and len(held[digit]) == 3:
            a, b, c = held[digit]
            u = a ^ b
            held[digit] = [u ^ c]
            put((a & b) | (u & c), digit + 1)
    return [x[0] for x in held]


def reaching(digits: list[np.ndarray], least: int) -> np.ndarray:
    """The rows whose counts are ``least`` at least, as bit sets."""
    if least >> len(digits):
        return np.zeros_like(digits[0])
    more, equal = np.zeros_like(digits[0]), np.full_like(digits[0], ~np.uint64(0))
    for i in range(len(digits) - 1, -1, -1):
        if least >> i & 1:
            equal &= digits[i]
        else:
            more |= equal & digits[i]
            equal &= ~digits[i]
    return more | equal


class Shard:
    """Sorted projections of a shard's rows; rows have to be scaled to norms of at most 1.

    A line's sorted array is kept as the sets of rows up to each step of a grid, so that the rows in a window are the
    difference of two sets and collisions are counted for 64 rows at once.
    """

    def __init__(self, rows: np.ndarray, lines: int = LINES, seed: int = 11):
        self.lines = np.random.default_rng(seed).standard_normal((rows.shape[1] + 1, lines)).astype(np.float32)
        rest = np.sqrt(np.maximum(0.0, 1.0 - (rows * rows).sum(axis=1)))
        values = np.concatenate([rows, rest[:, None]], axis=1).astype(np.float32) @ self.lines
        self.n, self.m = values.shape
        self.low = float(values.min(initial=0.0)) - GRID
        steps = np.maximum(1, np.ceil((values - self.low) / GRID)).astype(np.uint16)
        self.top = int(steps.max(initial=1))
        edges = np.arange(self.top + 1, dtype=np.uint16)[:, None]
        if self.top < 256:  # narrow numbers are compared faster
            steps, edges = steps.astype(np.uint8), edges.astype(np.uint8)
        steps = np.ascontiguousarray(steps.T)
        words = -(-self.n // 64)
        self.upto = np.zeros((self.m, self.top + 1, words), dtype=np.uint64)
        for line in range(self.m):
            bits = np.packbits(steps[line] <= edges, axis=1, bitorder="little")
            self.upto[line].view(np.uint8)[:, : bits.shape[1]] = bits
        self.begin = HALF
        # how wide windows are to begin with: a step short of what the narrowest of a few rows needs
        few = rows[:: max(1, self.n // 8)]
        self.begin = max(HALF, min((half for _, half in self._widen(few, 0)), default=HALF) / GROW)

    def _colliding(self, centres: np.ndarray, half: float) -> np.ndarray:
        ends = lambda x: np.clip(np.rint((x - self.low) / GRID), 0, self.top).astype(np.int64)
        a, b = ends(centres - half), ends(centres + half)
        digits = added(self.upto[i, b[:, i]] ^ self.upto[i, a[:, i]] for i in range(self.m))
        return reaching(digits, int(np.ceil(THRESHOLD * self.m)))

    def _widen(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, float]]:
        """Of each query the rows found, and the window's half-width."""
        wanted = min(self.n, 10 * k + int(ENOUGH * self.n))
        centres = queries.astype(np.float32) @ self.lines[:-1]
        out: list = [None] * len(queries)
        for at in range(0, len(queries), AT_ONCE):
            asking, half = np.arange(at, min(at + AT_ONCE, len(queries))), self.begin
            while len(asking):
                found = self._colliding(centres[asking], half)
                over = np.bitwise_count(found).sum(axis=1) >= wanted
                if half > (self.top + 1) * GRID + np.abs(centres[asking]).max():
                    over[:] = True  # the windows hold everything
                for i in np.flatnonzero(over):
                    out[asking[i]] = np.flatnonzero(np.unpackbits(found[i].view(np.uint8), count=self.n, bitorder="little")), half
                asking, half = asking[~over], half * GROW
        return out

    def candidates(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """Of each query, of norm 1, the rows with enough collisions."""
        return [found for found, _ in self._widen(queries, k)]


def best_of(x: np.ndarray, x32: np.ndarray, found: np.ndarray, ids: np.ndarray, one: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the rows found, and their inner products in double precision, nearest first, ties to smaller ids.

    Single precision leaves out those that its error cannot bring among the k best.
    """
    if len(found) > k:
        rough = x32[found] @ one.astype(np.float32)
        error = 1e-6 * x.shape[1] * np.linalg.norm(one) * (np.abs(x32).max() * math.sqrt(x.shape[1]))
        found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - error]
    scores = (x[found] * one).sum(axis=1)
    best = np.lexsort((ids[found], -scores))[:k]
    return found[best], scores[best]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(values), -1)


def search(data: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product found for each row that ``queries`` holds for.

    Scores are in double precision on the vectors as they are; ties go to the smaller id, null ids last.  All rows but
    those with the query's own id are searched.  Vectors that are null, empty, zero, or hold a null or non-finite component
    take no part; vectors of different lengths are not compared.  Repeated rows are results of their own, and a repeated
    query is answered once.  Rows with a null id are no queries.  With fewer rows than k all are returned; an empty table
    gives an empty result.
    """
    v = F.col(vector_col)
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = data.where(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = common.stored(rows.withColumn("dim", F.size("v")).withColumn("at", F.monotonically_increasing_id()))
    size = rows.groupBy("dim").agg(F.count("*").alias("rows"), F.sum(F.col("asks").cast("long")).alias("queries"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))
    top = size.agg(F.max("rows"), F.max("queries"), F.max("norm")).first()
    shards, blocks, norm = max(1, -(-(top[0] or 0) // shard_rows)), max(1, -(-(top[1] or 0) // query_rows)), top[2] or 1.0
    deal = lambda n, salt: F.pmod(F.xxhash64("at", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("dim", "vec_id", "v", deal(shards, "shard").alias("shard")).withColumn("block", every(blocks))
    asked = rows.where("asks and vec_id is not null").groupBy("dim", "vec_id").agg(F.min("at").alias("at"))
    asked = rows.join(asked, ["dim", "vec_id", "at"], "left_semi") if not asked.isEmpty() else rows.where("false")
    right = asked.select("dim", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), deal(blocks, "block").alias("block")).withColumn("shard", every(shards))

    def find(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            x, q = matrix(rows["v"]), matrix(asked["q"])
            null = np.array([i is None for i in rows["vec_id"].to_pylist()])
            ids = np.array([(2**63 - 1) if i is None else i for i in rows["vec_id"].to_pylist()], dtype=np.int64)
            order = np.lexsort((*x.T[:4], ids))
            x, ids, null = x[order], ids[order], null[order]
            shard = Shard(x / norm)
            x32 = x.astype(np.float32)
            near = shard.candidates(q / np.linalg.norm(q, axis=1, keepdims=True), k)
            for query_id, one, found in zip(asked["query_id"].to_pylist(), q, near, strict=True):
                found, scores = best_of(x, x32, found[(ids[found] != query_id) | null[found]], ids, one, k)
                out[0] += [query_id] * len(found)
                out[1] += [None if null[i] else int(ids[i]) for i in found]
                out[2] += scores.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    left = left.toDF("l_dim", "vec_id", "v", "l_shard", "l_block")
    right = right.select("dim", "shard", "block", "query_id", "q").toDF("r_dim", "r_shard", "r_block", "query_id", "q")
    near = left.groupBy("l_dim", "l_shard", "l_block").cogroup(right.groupBy("r_dim", "r_shard", "r_block")).applyInArrow(find, "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
