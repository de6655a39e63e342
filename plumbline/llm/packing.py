"""Packing of documents into fixed windows: histogram packing by non-negative least squares.

Every document is tokenised, ended by an end id and cut into full windows and a remainder.  The remainders' lengths form
a histogram of at most ``window`` counts, whatever the number of documents.  All combinations of two or three lengths
that fill a window are enumerated, and non-negative least squares gives how often each is to be used so that the uses
match the histogram.  The repeat counts are rounded; what they leave over is packed greedily: pairs that fill a window
first, the rest end to end, longest first, cut at the window's end.

Only the histogram reaches the driver.  A remainder's place follows from its length and its rank among the remainders of
that length; ranks are a count within the tokenising task plus the sum of the counts of the tasks before it, so no text
is shuffled and a length that a third of all documents share is no hot key.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TOKEN_SCHEMA = "doc_id {id}, start long, length long, ids binary, doc_tokens long, part long, local_rank long"
#: A rank's bits in the joint key of length and rank.
RANK_BITS = 44


class Encoder:
    """ids of the byte-level BPE in ``path``: the ids that the tokenizers library gives, by a faster route.

    The vocabulary's own split rule needs a look-ahead only where white space follows white space; texts without such
    places are split by a rule without it.  Special-token strings in a text are ordinary text here.
    """

    def __init__(self, path: str):
        import base64
        import re

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        rule = public_tokenizers.PATTERN
        tail = r"|\s+(?!\S)|\s+"
        assert rule.endswith(tail), "an unknown split rule"
        make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole, self.simple = make("whole", rule), make("simple", rule.removesuffix(tail) + r"|\s")
        self.runs = re.compile(r"\s\s")

    def __call__(self, text: str) -> list[int]:
        return (self.whole if self.runs.search(text) else self.simple).encode_ordinary(text)


class Library:
    """ids of a tokenizer's JSON file as the tokenizers library gives them, without special tokens at the ends.

    Strings of added tokens in a text are those tokens.  Texts without any take the faster route of Encoder, where the
    same vocabulary's ranks lie beside the file.
    """

    def __init__(self, path: str):
        import json
        import re
        from pathlib import Path

        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        added = [t["content"] for t in json.loads(Path(path).read_text(encoding="utf-8"))["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        ranks = Path(path).with_suffix(".tiktoken")
        self.ordinary = encoder(str(ranks)) if ranks.exists() else None

    def __call__(self, text: str) -> list[int]:
        if self.ordinary is not None and not self.added.search(text):
            return self.ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


_encoders: dict[str, Encoder | Library] = {}


def encoder(path: str) -> Encoder | Library:
    """One encoder a Python worker and file: the library's for JSON files, one of ordinary text for ranks."""
    if path not in _encoders:
        _encoders[path] = Library(path) if path.endswith(".json") else Encoder(path)
    return _encoders[path]


def combinations(window: int) -> np.ndarray:
    """All ways to fill a window by two or three lengths: rows (a, b, c) with a >= b >= c >= 0 and a sum of window."""
    a = np.arange(1, window)
    two = np.stack([a, window - a, 0 * a], axis=1)
    two = two[two[:, 0] >= two[:, 1]]
    b, c = np.meshgrid(np.arange(1, window // 2 + 1), np.arange(1, window // 3 + 1), indexing="ij")
    three = np.stack([window - b.ravel() - c.ravel(), b.ravel(), c.ravel()], axis=1)
    three = three[(three[:, 0] >= three[:, 1]) & (three[:, 1] >= three[:, 2])]
    return np.concatenate([two, three])


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the combinations that minimise |A x - histogram|: accelerated projected gradient.

    A's column of a combination counts its lengths, so A x is a bincount and A' r three look-ups.
    """
    n, size = len(combos), len(histogram)
    columns = [np.ascontiguousarray(combos[:, i]) for i in range(combos.shape[1])]

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(c, x, minlength=size) for c in columns)
        out[0] = 0.0  # a combination of two has 0 for its third length
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return sum(r[c] for c in columns)

    v = np.ones(n)
    for _ in range(12):
        v = back(forward(v))
        bound = np.linalg.norm(v)
        v /= bound
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - back(forward(y) - histogram) / (1.05 * bound))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


@dataclass
class Plan:
    """Where the r-th remainder of each length goes.  keys are length << RANK_BITS | first rank, sorted; from a key on,
    sequence and offset are sequence0 + (rank - rank0) and offset0, or for a run laid end to end, from position0."""

    window: int
    keys: np.ndarray
    rank0: np.ndarray
    sequence0: np.ndarray
    offset0: np.ndarray
    position0: np.ndarray
    laid: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, (length << RANK_BITS) | rank, side="right") - 1
        on = rank - self.rank0[i]
        position = self.position0[i] + on * length
        laid = self.laid[i]
        return np.where(laid, self.sequence0[i] + position // self.window, self.sequence0[i] + on), np.where(laid, position % self.window, self.offset0[i])


def plan(histogram: np.ndarray, window: int) -> Plan:
    """histogram[l]: remainders (and at window: full windows) of l tokens."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int, bool]] = []  # length, rank0, sequence0, offset0, position0, laid
    sequences = 0

    def take(lengths: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for one in lengths:
            rows.append((one, int(used[one]), sequences, offset, 0, False))
            used[one] += times
            left[one] -= times
            offset += one
        sequences += times

    if left[window]:
        take([window], int(left[window]))
    if left.sum() and window > 2:
        combos = combinations(window)
        combos = combos[((left[combos] > 0) | (combos == 0)).all(axis=1)]
        if len(combos):
            order = np.lexsort((combos[:, 2], combos[:, 1], -combos[:, 0]))
            combos = combos[order]
            target = left.astype(np.float64)
            target[window] = 0
            x = solve(combos, target)
            whole = np.diff(np.floor(np.concatenate([[0.0], np.cumsum(x)]) + 0.5)).astype(np.int64)
            for i in np.flatnonzero(whole):
                lengths = [int(v) for v in combos[i] if v]
                times = min(int(whole[i]), *(int(left[v]) // k for v, k in Counter(lengths).items()))
                if times > 0:
                    take(lengths, times)
    for one in range(window - 1, window // 2, -1):  # greedily: pairs that fill a window
        if (times := min(int(left[one]), int(left[window - one]))) > 0:
            take([one, window - one], times)
    if window % 2 == 0 and (times := int(left[window // 2]) // 2) > 0:
        take([window // 2, window // 2], times)
    position = 0
    for one in range(window - 1, 0, -1):  # and the rest end to end, longest first
        if left[one]:
            rows.append((one, int(used[one]), sequences, 0, position, True))
            position += int(left[one]) * one
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    return Plan(window, (table[:, 0] << RANK_BITS) | table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4], table[:, 5].astype(bool))


def tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Each document's ids, the end id last, cut into windows: full ones and, if any, a shorter last one.

    local_rank counts the pieces of a length within the task (part).  ids are unsigned little-endian 32-bit numbers.
    """
    path = tokenizer or common.tokenizer_path("byte_bpe_50k.json")
    common.small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = TOKEN_SCHEMA.format(id=narrow.schema["doc_id"].dataType.simpleString())

    def run(batches):
        from pyspark import TaskContext

        encode, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    n = len(piece)
                    for col, value in zip(cols, (doc_id, start, n, piece.tobytes(), len(ids), part, seen[n]), strict=True):
                        col.append(value)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=batch.column(0).type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[4:])], names=["doc_id", "start", "length", "ids", "doc_tokens", "part", "local_rank"])

    return narrow.mapInArrow(run, schema)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` ids; returns the pieces.

    Columns: doc_id, start, length, ids (binary, unsigned little-endian 32-bit), doc_tokens, sequence_id, offset.  Each id
    of a document lies in exactly one piece; the pieces of a sequence lie at offsets without gaps from 0.  All sequences
    but one are full.

    A null or empty text is the end id alone.  Null ids and repeated rows are documents like any other.  Ties among pieces
    of a length are decided by the order of tasks and rows.  An empty table gives no pieces.  Further columns are ignored.
    """
    cut = common.stored(tokens(docs, id_col=id_col, text_col=text_col, window=window, end_id=end_id, tokenizer=tokenizer))
    counts = common.stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        histogram[row["length"]] = row["n"]
    where = plan(histogram, window)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = common.small_side(counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_rank")), 160, counts.count())

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = where.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    at = cut.join(base, ["part", "length"]).withColumn("at", place("length", F.col("base_rank") + F.col("local_rank")))
    here = F.least("length", F.lit(window) - F.col("at.offset"))
    part = lambda skip, n, sequence, offset: F.struct((F.col("start") + skip).alias("start"), n.cast("long").alias("length"), F.expr("ids").substr((skip * 4 + 1).cast("int"), (n * 4).cast("int")).alias("ids"), sequence.alias("sequence_id"), offset.cast("long").alias("offset"))
    first = part(F.lit(0), here, F.col("at.sequence_id"), F.col("at.offset"))
    second = part(here, F.col("length") - here, F.col("at.sequence_id") + 1, F.lit(0))
    pieces = at.select("doc_id", "doc_tokens", F.explode(F.when(here < F.col("length"), F.array(first, second)).otherwise(F.array(first))).alias("piece"))
    return pieces.select("doc_id", "piece.start", "piece.length", "piece.ids", "doc_tokens", "piece.sequence_id", "piece.offset")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 1024; the ids as a checksum."""
    packed = pack(common.read(spark, sf_dir, "documents"), window=1024, end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
