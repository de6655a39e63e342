"""Modified Kneser-Ney trigrams of any number of trusted texts: counted, and scored, in parts by the middle word.

All that a trigram's probability needs, but the share of its last word alone, lies with its middle word: its count, the
total of its context, the contexts that its last two words follow.  So trigrams are dealt out by the middle word, in
training and in scoring; a word with very many trigrams is dealt out by the word before it too, and each of its parts gets
all its bigrams.  A part's tables are as those of the whole model, so nothing but the word counts is sent to all tasks, and
of these only the most frequent, up to a fixed number.  A last word that isn't among them is joined with its share by a
shuffle: a trigram's probability is a + b times that share, and its part gives a and b.

Trigrams travel as ranks of words by frequency, compressed.  Texts are scored in ROUNDS, so that only a round's trigrams
are on disk at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common
from .kn_quality import BEGIN, END, Model, Table, discounts_of, signed
from .kn_quality import trigram_hashes as hashes
from .shingling import word_hashes

#: Words that are sent to every task, at most.
FREQUENT_WORDS = 1 << 21
#: Trained words of a part, about, and of the part of one middle word; parts at least.
PART_WORDS, ONE_WORD, LEAST_PARTS = 1 << 20, 1 << 18, 24
#: Words that a task holds before it deals them out.
MOST_HELD = 1 << 21
ROUNDS = 3
#: Stands for every word that training hasn't, where all words that it has are sent.
UNKNOWN = np.uint64(0x5DEECE66D1234567)
#: Bytes of packed trigrams that cross into Python at a time.
BATCH_BYTES = 8 << 20
TRIGRAMS, BIGRAMS, WORDS = 0, 1, 2
COUNTED = "kind int, part int, n binary, c1 long, c2 long, c3 long, c4 long"


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """Batches of few bytes, and shuffles that are deleted with the query that wrote them."""
    new = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class Words:
    """The most frequent trained words by rank, with their counts; complete: there are no others. parts: how many there are."""

    ranked: np.ndarray
    n: np.ndarray
    complete: bool
    parts: int
    order: np.ndarray = field(init=False)
    spread: np.ndarray = field(init=False)

    def __post_init__(self):
        self.order = np.argsort(self.ranked).astype(np.int32)
        # in how many parts a middle word's trigrams are, by rank; of words without a rank, in one
        self.spread = np.append(np.minimum(self.parts, 1 + self.n // ONE_WORD), 1).astype(np.uint64)

    def ranks(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of words, and the others: these have the ranks after the last, in the order that is returned."""
        unique, back = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(self.ranked, unique, sorter=self.order), len(self.ranked) - 1)
        rank = self.order[at].astype(np.int64)
        other = self.ranked[rank] != unique
        others = np.full(1, UNKNOWN) if self.complete else unique[other]
        rank[other] = len(self.ranked) + (0 if self.complete else np.arange(len(others)))
        return rank[back], others

    def hashes(self, ranks: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.concatenate([self.ranked, others])[ranks]

    def part(self, u: np.ndarray, v: np.ndarray, v_rank: np.ndarray) -> np.ndarray:
        """Parts of trigrams by the hashes of the middle word and the one before. Unknown words before may lie in any of the word's parts."""
        some = np.where(u == UNKNOWN, np.arange(len(u), dtype=np.uint64), u)
        return ((v + some % self.spread[np.minimum(v_rank, len(self.ranked))]) % np.uint64(self.parts)).astype(np.int32)


def pack(words: Words, ranks: list[np.ndarray], others: np.ndarray, numbers: list[np.ndarray]) -> bytes:
    """Columns of ranks and of numbers, compressed; of the words without a rank, only those that occur."""
    first = len(words.ranked)
    if len(others) > 1:
        used = np.unique(np.concatenate([r[r >= first] for r in ranks]))
        moved = [np.where(r < first, r, first + np.searchsorted(used, r)) for r in ranks]
        ranks, others = moved, others[used - first]
    planes = [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in (*ranks, *numbers)]
    raw = b"".join([np.array([len(ranks[0]), len(others)], "<i8").tobytes(), others.astype("<u8").tobytes(), *planes])
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = pa.decompress(packed[8:], int(np.frombuffer(packed, "<i8", 1)[0]), codec="zstd", asbytes=True)
    n, m = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    others = np.frombuffer(raw, "<u8", m, 16)
    planes = np.frombuffer(raw, np.uint8, offset=16 + 8 * m).reshape(columns, 4, n)
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes], others


def by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(parts, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(parts[order]) != 0)) if len(parts) else []
    for lo, hi in zip(starts, [*starts[1:], len(parts)], strict=True):
        yield int(parts[order[lo]]), order[lo:hi]


def held(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of texts with the hashes of their words, up to about MOST_HELD words at a time."""
    for batch in batches:
        lo = size = 0
        words: list[np.ndarray] = []
        for i, text in enumerate(batch.column(column).to_pylist()):
            words.append(np.concatenate([[BEGIN, BEGIN], word_hashes(text), [END]]).astype(np.uint64))
            size += len(words[-1])
            if size > MOST_HELD:
                yield batch.slice(lo, i + 1 - lo), words
                lo, size, words = i + 1, 0, []
        if words:
            yield batch.slice(lo), words


def merged(batches: Iterable[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Lists of texts' words, put together up to about MOST_HELD words."""
    out: list[np.ndarray] = []
    size = 0
    for words in batches:
        out += words
        size += sum(map(len, words))
        if size > MOST_HELD:
            yield out
            out, size = [], 0
    if out:
        yield out


def targets(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of texts, the places of those that have two before them, and to which text these belong."""
    sizes = np.array([len(w) for w in words])
    inside = np.ones(sizes.sum(), dtype=bool)
    starts = np.cumsum(sizes) - sizes
    inside[starts] = inside[starts + 1] = False
    return np.concatenate(words), np.flatnonzero(inside), np.repeat(np.arange(len(words)), sizes - 2)


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n. texts: one column."""

    def run(batches):
        for words in merged(w for _, w in held(batches, 0)):
            keys, n = np.unique(np.concatenate(words), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n, pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> Words:
    """counts: word, n."""
    total = counts.agg(F.sum("n")).first()[0]
    least, have, complete = 1 << 62, 0, True
    sizes = counts.groupBy(F.floor(F.log2("n") * 16).alias("size")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    for row in sorted(sizes.collect(), key=lambda r: -r["size"]):  # at most 16 * 63 rows
        have += row["words"]
        if have > FREQUENT_WORDS:
            complete = False
            break
        least = row["least"]
    got = counts.where(F.col("n") >= least).toArrow()  # at most FREQUENT_WORDS rows
    hashed, n = got["word"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.lexsort([hashed, -n])
    ranked, n = hashed[order], n[order]
    if not len(ranked):  # too many of the same count
        ranked, n = np.array([END]), np.zeros(1, np.int64)
    return Words(ranked, n, complete, max(LEAST_PARTS, -(-total // PART_WORDS)))


def few(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def row(kind: int, part: int, packed: bytes, c: list[int]) -> pa.RecordBatch:
    cells = [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([packed], pa.binary()), *(pa.array([x], pa.int64()) for x in c)]
    return pa.RecordBatch.from_arrays(cells, names=["kind", "part", "n", "c1", "c2", "c3", "c4"])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key first is, and the sum of its n."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return first, np.bincount(back, n, minlength=len(first)).astype(np.int64)


def read_counts(shared: Words, batches: Iterable[pa.RecordBatch], at: int, columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the words of packed rows, and the counts behind them."""
    parts = []
    for batch in batches:
        for packed in batch.column(at).to_pylist():
            (*ranks, n), others = unpack(packed, columns + 1)
            parts.append([*(shared.hashes(r, others) for r in ranks), n])
    *words, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    return words, n


def count(texts: DataFrame, words) -> tuple[DataFrame, DataFrame, list, list, DataFrame]:
    """Trigrams and bigrams in parts, packed; their counts of counts; and of every word how many differ before it."""
    NONE = [0, 0, 0, 0]

    def deal(batches):
        w = words.value
        for some in merged(x for _, x in held(batches, 0)):
            whole, at, _ = targets(some)
            ranks, others = w.ranks(whole)
            for part, i in by_part(w.part(whole[at - 2], whole[at - 1], ranks[at - 1])):
                i = at[i]
                yield row(TRIGRAMS, part, pack(w, [ranks[i - 2], ranks[i - 1], ranks[i]], others, [np.ones(len(i))]), NONE)

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words.value
        part = None

        def keep():
            nonlocal part
            for batch in batches:
                part = batch.column(1)[0].as_py() if batch.num_rows else part
                yield batch

        (u, v, x), n = read_counts(w, keep(), 2, 3)
        first, n = summed(hashes(u, v, x)[0], n)
        u, v, x = u[first], v[first], x[first]
        order = np.lexsort([x, u, v])
        u, v, x, n = u[order], v[order], x[order], n[order]
        ranks, others = w.ranks(np.concatenate([u, v, x]))
        ur, vr, xr = np.split(ranks, 3)
        yield row(TRIGRAMS, part, pack(w, [ur, vr, xr], others, [n]), few(n))
        first, n = summed(hashes(u, v, x)[2], np.ones(len(x)))
        for home, i in by_part((v[first] % np.uint64(w.parts)).astype(np.int32)):
            j = first[i]
            yield row(BIGRAMS, home, pack(w, [vr[j], xr[j]], others, [n[i]]), NONE)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words.value
        (v, x), n = read_counts(w, batches, 2, 2)
        first, n = summed(hashes(v, v, x)[2], n)
        v, x = v[first], x[first]
        ranks, others = w.ranks(np.concatenate([v, x]))
        vr, xr = np.split(ranks, 2)
        many = w.spread[np.minimum(vr, len(w.ranked))]
        counted = few(n)
        for s in range(int(many.max(initial=1))):
            for part, i in by_part(np.where(many > s, (v + np.uint64(s)) % np.uint64(w.parts), w.parts).astype(np.int32)):
                if part < w.parts:
                    yield row(BIGRAMS, part, pack(w, [vr[i], xr[i]], others, [n[i]]), counted)
                    counted = NONE
        first, n = summed(x, np.ones(len(x)))
        yield row(WORDS, 0, pack(w, [xr[first]], others, [n]), NONE)

    def last(batches):
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                (ranks, n), others = unpack(packed, 2)
                yield pa.RecordBatch.from_arrays([pa.array(signed(words.value.hashes(ranks, others))), pa.array(n)], names=["word", "n"])

    sums = [F.sum(f"c{i}") for i in (1, 2, 3, 4)]
    dealt = texts.mapInArrow(deal, COUNTED)
    tri = common.stored(dealt.groupBy("part").applyInArrow(trigrams, COUNTED))
    c3 = list(tri.agg(*sums).first())
    bi = common.stored(tri.where(F.col("kind") == BIGRAMS).groupBy("part").applyInArrow(bigrams, COUNTED))
    c2 = list(bi.agg(*sums).first())
    before = bi.where(F.col("kind") == WORDS).select("n").mapInArrow(last, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return tri.where(F.col("kind") == TRIGRAMS), bi.where(F.col("kind") == BIGRAMS), c3, c2, common.stored(before)


def discounted(context: np.ndarray, n: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each n-gram's discounted share of its context; the contexts and their weights."""
    taken = np.array([0.0, *d])[np.minimum(n, 3)]
    keys, back = np.unique(context, return_inverse=True)
    total = np.bincount(back, n, minlength=len(keys))
    return (n - taken) / total[back], keys, np.bincount(back, taken, minlength=len(keys)) / total


def part_model(shared: Words, tri: list[bytes], bi: list[bytes], d3: list[float], d2: list[float]) -> Model:
    """The model of a part, without the words' shares."""

    def level(packed: list[bytes], columns: int, d: list[float]) -> tuple[Table, Table]:
        if not packed:
            none = np.empty(0, np.int64)
            return Table(none, none), Table(none, none, 1.0)
        batch = pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["n"])
        words, n = read_counts(shared, [batch], 0, columns)
        u, v, x = words if columns == 3 else (words[0], *words)
        tri_, uv, vx = hashes(u, v, x)
        key, context = (tri_, uv) if columns == 3 else (vx, v)
        share, contexts, weight = discounted(context, n, d)
        return Table(signed(key), share), Table(signed(contexts), weight, 1.0)

    share3, weight3 = level(tri, 3, d3)
    share2, weight2 = level(bi, 2, d2)
    none = np.empty(0, np.int64)
    return Model(share3, weight3, share2, weight2, Table(none, none), 0.0)


def score(docs: DataFrame, training: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity of all docs (doc_id, lang, text), by the training texts. counts: their word_counts()."""
    spark = docs.sparkSession
    context = spark.sparkContext
    with settings(spark):
        w = frequent(counts)
        words = context.broadcast(w)
        tri, bi, c3, c2, before = count(training, words)
        d3, d2 = discounts_of(c3), discounts_of(c2)
        have = {r["n"]: r["c"] for r in before.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
        d1 = discounts_of([have.get(i, 0) for i in (1, 2, 3, 4)])
        taken = F.when(F.col("n") == 1, d1[0]).when(F.col("n") == 2, d1[1]).otherwise(d1[2])
        total, off, distinct = before.agg(F.sum("n"), F.sum(taken), F.count("*")).first()
        unknown = off / total / (distinct + 1)
        share = before.select("word", ((F.col("n") - taken) / total + unknown).alias("p"))
        ranked = share if w.complete else share.join(F.broadcast(spark.createDataFrame(pa.table({"word": signed(w.ranked)}))), "word", "left_semi")
        got = ranked.toArrow()  # at most FREQUENT_WORDS rows
        p1 = np.full(len(w.ranked) + 1, unknown)
        rank, _ = w.ranks(got["word"].to_numpy().view(np.uint64))
        p1[rank] = got["p"].to_numpy()
        p1[len(w.ranked) :] = unknown
        shares1 = context.broadcast(p1.astype(np.float32))

        model = tri.select("part", F.lit(0).alias("turn"), "kind", "n").unionByName(bi.select("part", F.lit(0).alias("turn"), "kind", "n"))
        done = [common.stored(one_round(docs.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == i), model, words, shares1, d3, d2, share, unknown)) for i in range(ROUNDS)]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def one_round(docs: DataFrame, model: DataFrame, words, shares1, d3: list[float], d2: list[float], share: DataFrame, unknown: float) -> DataFrame:
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    # a group: the texts that a task deals out at a time. One row of it lists them, the others are trigrams of theirs.
    listing = f"array<struct<doc_id: {doc_type}, lang: string, n_tokens: long>>"
    rows = f"group long, docs {listing}, sums binary, rest array<struct<i: int, word: long, a: double, b: double>>"
    types = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(rows))}

    def dealt(part, kind, packed, group, listed):
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int32()), pa.array([1], pa.int32()), pa.array([kind], pa.int32()), pa.array([packed], pa.binary()), pa.array([group], pa.int64()), listed,
        ], names=["part", "turn", "kind", "n", "group", "docs"])

    def deal(batches):
        w, p1 = words.value, shares1.value
        group = TaskContext.get().partitionId() << 32
        no_docs = pa.nulls(1, types["docs"])
        for batch, some in gathered(held(batches, 2)):
            whole, at, owner = targets(some)
            ranks, others = w.ranks(whole)
            v = ranks[at - 1]
            alone = v >= len(w.ranked) if w.complete else np.zeros(len(v), dtype=bool)  # after an unknown word, the last word's share counts
            sums = np.bincount(owner[alone], np.log10(p1[ranks[at[alone]]].astype(np.float64)), minlength=len(some))
            listed = pa.StructArray.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) - 2 for x in some], pa.int64())], fields=list(types["docs"].value_type))
            yield dealt(-1 - group_part(group, w.parts), -1, sums.tobytes(), group, pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), listed).cast(types["docs"]))
            at, owner, v = at[~alone], owner[~alone], v[~alone]
            known = w.hashes(ranks, others)
            for part, i in by_part(w.part(known[at - 2], known[at - 1], v)):
                j = at[i]
                yield dealt(part, len(some), pack(w, [ranks[j - 2], ranks[j - 1], ranks[j]], others, [owner[i]]), group, no_docs)
            group += 1

    def probabilities(batches):
        w, p1 = words.value, shares1.value
        part, tri, bi, local = None, [], [], None
        for batch in batches:
            for here, turn, kind, packed, group, at in zip(*(c.to_pylist() for c in batch.columns[:5]), range(batch.num_rows), strict=True):
                if here < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), batch.column(5).slice(at, 1).cast(types["docs"]), pa.array([packed], pa.binary()), pa.nulls(1, types["rest"])], names=list(types))
                    continue
                if here != part:
                    part, tri, bi, local = here, [], [], None
                if turn == 0:
                    (tri if kind == TRIGRAMS else bi).append(packed)
                    continue
                if local is None:
                    local = part_model(w, tri, bi, d3, d2)
                    tri, bi = [], []
                (ur, vr, xr, owner), others = unpack(packed, 4)
                u, v, x = (w.hashes(r, others) for r in (ur, vr, xr))
                a, b = local.mix(*hashes(u, v, x), v)
                last = np.zeros(len(x), dtype=bool) if w.complete else xr >= len(w.ranked)  # their shares are joined
                logs = np.log10(a[~last] + b[~last] * p1[np.minimum(xr[~last], len(p1) - 1)])
                sums = np.bincount(owner[~last], logs, minlength=kind)
                rest = pa.nulls(1, types["rest"])
                if last.any():
                    cells = pa.StructArray.from_arrays([pa.array(owner[last], pa.int32()), pa.array(signed(x[last])), pa.array(a[last]), pa.array(b[last])], fields=list(types["rest"].value_type))
                    rest = pa.ListArray.from_arrays(pa.array([0, int(last.sum())], pa.int32()), cells).cast(types["rest"])
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.nulls(1, types["docs"]), pa.array([sums.tobytes()], pa.binary()), rest], names=list(types))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, listed, group = 0.0, None, None
        for batch in batches:
            for i, (group_, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                total, group = total + np.frombuffer(packed), group_
                listed = batch.column(1).slice(i, 1).flatten() if batch.column(1)[i].is_valid else listed
        if listed is not None and len(listed):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(listed), group)), pa.array(np.arange(len(listed)), pa.int32()), *(listed.field(i) for i in range(3)), pa.array(np.array(total)),
            ], names=["group", "i", "doc_id", "lang", "n_tokens", "logs"])

    asked = docs.select("doc_id", "lang", "text").mapInArrow(deal, f"part int, turn int, kind int, n binary, group long, docs {listing}")
    all_ = model.withColumn("group", F.lit(None).cast("long")).withColumn("docs", F.lit(None).cast(asked.schema["docs"].dataType)).select(*asked.columns).unionByName(asked)
    parted = all_.repartition(words.value.parts, "part").sortWithinPartitions("part", "turn")
    given = parted.mapInArrow(probabilities, rows)
    summed_ = f"group long, i int, doc_id {doc_type}, lang string, n_tokens long, logs double"
    if words.value.complete:
        out, logs = given.groupBy("group").applyInArrow(add, summed_), F.col("logs")
    else:
        given = common.stored(given)
        rest = given.select("group", F.explode("rest").alias("r")).select("group", "r.*").join(share, "word", "left")
        more = rest.groupBy("group", "i").agg(F.sum(F.log10(F.col("a") + F.col("b") * F.coalesce("p", F.lit(unknown)))).alias("more"))
        out = given.groupBy("group").applyInArrow(add, summed_).join(more, ["group", "i"], "left")
        logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "lang", "n_tokens", F.pow(F.lit(10.0), -logs / F.col("n_tokens")).alias("perplexity"))


def group_part(group: int, parts: int) -> int:
    """Some part, for what may lie in any."""
    return (group + (group >> 32)) % parts


def gathered(rows: Iterable[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of texts, put together up to about MOST_HELD words."""
    batches, words, size = [], [], 0

    def both():
        return pa.Table.from_batches(batches).combine_chunks().to_batches()[0], words

    for batch, some in rows:
        batches.append(batch.select([0, 1]))
        words += some
        size += sum(map(len, some))
        if size > MOST_HELD:
            yield both()
            batches, words, size = [], [], 0
    if words:
        yield both()
