"""Quality by perplexity: an interpolated modified Kneser-Ney trigram model of words, trained on trusted text.

The trusted documents' trigrams are counted in Spark, sharded by hash; continuation counts and context totals are
aggregated from those counts and joined back to them by hash, which gives each n-gram its discounted share and each
context its interpolation weight.  A model of few words is sent to the tasks, in shards of hash ranges, and every
document's n-grams are joined with them where the document lies; a larger one stays in parts, to which the documents'
n-grams are dealt out (kn_shards).  All documents are scored whole.

Half of the trusted documents, by hash, train the model, all of them and whole.  A document is kept if its perplexity is at
most a quantile, of its own language, over the other half.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .shingling import _fold, word_hashes

#: A model of so many trained words at most is sent to the tasks.
SENT_WORDS = 2_000_000
#: Of a document, where the characters to train on are limited: at most this part of them, so that no long one crowds out the others.
ONE_DOCUMENT = 1 / 16
#: The quantile of a language's trusted perplexities, and how many of them it takes; with fewer, all languages' count.
QUANTILE, LEAST_TRUSTED = 0.999, 50
SHARDS = 64
BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\x00begin", b"\x00end"))


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, for every word of a text and its end: of trigram, of the two words before, of bigram, of the word before, of the word."""
    w = np.concatenate([[BEGIN, BEGIN], word_hashes(text), [END]]).astype(np.uint64)
    u, v, x = w[:-2], w[1:-1], w[2:]
    return *trigram_hashes(u, v, x), v, x


def trigram_hashes(u: np.ndarray, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of three words: of all, of the first two, of the last two."""
    pair = lambda a, b: _fold(_fold(np.full(len(a), 2, dtype=np.uint64), a), b)
    uv, vx = pair(u, v), pair(v, x)
    return _fold(_fold(np.full(len(u), 3, dtype=np.uint64), uv), x), uv, vx


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


class Table:
    """Values by hash, in shards of hash ranges; 0 (or ``missing``) where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float = 0.0):
        unsigned = keys.view(np.uint64)
        order = np.argsort(unsigned)
        keys, values = unsigned[order], values[order].astype(np.float32)
        cuts = np.searchsorted(keys, np.arange(1, SHARDS, dtype=np.uint64) << np.uint64(64 - int(math.log2(SHARDS))))
        self.shards = list(zip(np.split(keys, cuts), np.split(values, cuts), strict=True))
        self.missing = np.float32(missing)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The join of sorted keys with the shards."""
        unique, back = np.unique(keys, return_inverse=True)
        out = np.full(len(unique), self.missing, dtype=np.float32)
        cuts = np.searchsorted(unique, np.arange(1, SHARDS, dtype=np.uint64) << np.uint64(64 - int(math.log2(SHARDS))))
        at = 0
        for (have, values), part in zip(self.shards, np.split(unique, cuts), strict=True):
            if len(part) and len(have):
                i = np.minimum(np.searchsorted(have, part), len(have) - 1)
                out[at : at + len(part)] = np.where(have[i] == part, values[i], self.missing)
            at += len(part)
        return out[back]


@dataclass
class Model:
    share3: Table
    weight3: Table
    share2: Table
    weight2: Table
    share1: Table
    unknown: float

    def mix(self, tri: np.ndarray, uv: np.ndarray, vx: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a and b: a trigram's probability is a + b times its last word's."""
        weight = self.weight3.get(uv).astype(np.float64)
        return self.share3.get(tri) + weight * self.share2.get(vx), weight * self.weight2.get(v)

    def log_probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each text with its end, and its tokens (words and the end)."""
        parts = [grams(t) for t in texts]
        sizes = np.array([len(p[0]) for p in parts])
        tri, uv, vx, v, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        a, b = self.mix(tri, uv, vx, v)
        p = a + b * (self.share1.get(x).astype(np.float64) + self.unknown)
        return np.bincount(np.repeat(np.arange(len(texts)), sizes), np.log10(p), minlength=len(texts)), sizes


def discounts(ngrams: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from the counts of counts."""
    have = {r["c"]: r["n"] for r in ngrams.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    return discounts_of([have.get(i, 0) for i in (1, 2, 3, 4)])


def discounts_of(counts: list[int]) -> list[float]:
    n = [0, *(max(1, c) for c in counts)]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n[2] / n[1]), (2, 2 - 3 * y * n[3] / n[2]), (3, 3 - 4 * y * n[4] / n[3]))]


def shares(ngrams: DataFrame, context: str) -> tuple[DataFrame, DataFrame]:
    """Of n-grams (key, context, c): each one's discounted share of its context, and each context's weight for the order below."""
    d1, d2, d3 = discounts(ngrams)
    d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
    totals = ngrams.groupBy(context).agg(F.sum("c").alias("total"), F.sum(d).alias("taken"))
    joined = ngrams.join(totals, context).select("key", ((F.col("c") - d) / F.col("total")).alias("value"))
    return joined, totals.select(F.col(context).alias("key"), (F.col("taken") / F.col("total")).alias("value"))


def fit(sample: DataFrame) -> Model | None:
    """The model of a column of texts, few enough to send it to the tasks."""

    def run(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                cols = [signed(c) for c in grams(text)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["tri", "uv", "vx", "v", "x"])

    tokens = sample.mapInArrow(run, "tri long, uv long, vx long, v long, x long")
    tri = common.stored(tokens.groupBy("tri", "uv", "vx", "v", "x").agg(F.count("*").alias("c")).withColumnRenamed("tri", "key"))
    if tri.isEmpty():
        return None
    bi = common.stored(tri.groupBy("vx", "v", "x").agg(F.count("*").alias("c")).withColumnRenamed("vx", "key"))
    uni = common.stored(bi.groupBy("x").agg(F.count("*").alias("c")).withColumn("key", F.col("x")).withColumn("all", F.lit(0)))
    s3, w3 = shares(tri, "uv")
    s2, w2 = shares(bi, "v")
    s1, w1 = shares(uni, "all")
    words = uni.count()

    def table(df: DataFrame, missing: float = 0.0) -> Table:
        got = df.toArrow()  # of few texts
        return Table(got["key"].to_numpy(), got["value"].to_numpy(), missing)

    return Model(table(s3), table(w3, 1.0), table(s2), table(w2, 1.0), table(s1), w1.first()["value"] / (words + 1))


def score_by(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity of docs (doc_id, lang, text), by a model that is sent to the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            logs, sizes = (shared.value.log_probabilities(texts) if shared.value else (np.zeros(len(texts)), np.array([len(grams(t)[0]) for t in texts]))) if texts else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes.astype(np.int64)), pa.array(10.0 ** (-logs / np.maximum(1, sizes)))], names=["doc_id", "lang", "n_tokens", "perplexity"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return common.stored(docs.mapInArrow(run, f"doc_id {id_type}, lang string, n_tokens long, perplexity double"))


def classify(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_documents: int | None = None, train_characters: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity, threshold, kept for every document; trusted holds ids of trusted documents.

    kept: the text has a word and its perplexity is at most the threshold of its language.  A null language is a language
    of its own.  Languages with few trusted documents take the threshold over all trusted ones; with no trusted document to
    train on, nothing is rejected but texts without words, and a warning says so.  A null text counts as an empty one.  Trusted ids that are null or without a
    document are ignored, and repeated ones count once.  Repeated rows get equal rows; an empty table gives an empty
    result; further columns are ignored.  train_documents and train_characters limit what is trained on to those of
    smallest hash; without them, all are.
    """
    from . import kn_shards

    common.small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    good = trusted.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    # half of the trusted documents are never trained on: the thresholds come from them
    first_half = F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(2)) == 0
    picked = good.where(first_half)
    if train_documents is not None:
        picked = picked.orderBy(F.xxhash64("__id"), "__id").limit(train_documents)
    chosen = narrow.join(common.small_side(picked, 32), F.col("doc_id") == F.col("__id")).where("text is not null").select("doc_id", "text")
    if train_characters is not None:
        chosen = chosen.withColumn("text", F.substring("text", 1, max(1, int(train_characters * ONE_DOCUMENT))))
        upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        chosen = common.stored(chosen.withColumn("__sum", F.sum(F.length("text")).over(upto)).where(F.col("__sum") <= train_characters).select("doc_id", "text"))
    counts = common.stored(kn_shards.word_counts(chosen.select("text")))
    words = counts.agg(F.sum("n")).first()[0] or 0
    if not words:
        warnings.warn("no trusted text to learn from: all documents with words are kept", stacklevel=2)
    scored = kn_shards.score(narrow, chosen.select("text"), counts) if words > SENT_WORDS else score_by(narrow, fit(chosen.select("text")) if words else None)
    unseen = good.where(~first_half) if train_documents is None and train_characters is None else good.join(chosen.select(F.col("doc_id").alias("__id")).distinct(), "__id", "left_anti")
    reference = common.stored(scored.where("n_tokens > 1").join(common.small_side(unseen, 32), F.col("doc_id") == F.col("__id")).select("lang", "perplexity"))
    at = F.expr(f"percentile_disc({float(quantile)!r}) within group (order by perplexity)")
    overall = reference.agg(at.alias("q")).first()["q"]
    by_lang = reference.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__n"), at.alias("__q")).where(F.col("__n") >= LEAST_TRUSTED)
    by_lang = common.stored(by_lang)
    limit = F.coalesce(F.col("__q"), F.lit(overall).cast("double"))
    out = scored.join(common.small_side(by_lang, 64), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    kept = (F.col("n_tokens") > 1) & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", limit.alias("threshold"), kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    labels = common.read(spark, sf_dir, "labels")
    return classify(common.read(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0"))
