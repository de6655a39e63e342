"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text's n-grams (of 1 to 3 code points, lower-cased letters, all else as one blank) are hashed into a fixed number of
buckets.  Training sums bucket counts by language over all training documents: each task adds up its own counts and the
sums are aggregated by key, so what reaches the driver is one row of counts a language, whatever the corpus.  The matrix
of log-probabilities (languages x buckets) is broadcast, and each batch of texts is scored by numpy from the counts of
the buckets that occur.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDERS = 3
BITS = 14
#: Most cells of the matrix; with so many languages that it would be larger, n-grams share fewer buckets.
MOST_CELLS = 1 << 24
#: Numbers that a part of a batch is scored by at a time.
AT_ONCE = 1 << 21
UNDETERMINED = "und"
#: Code points that a text is cut into for counting; bounds the memory of very long texts.
CHUNK = 1 << 20

_letter = re.compile(r"[^\W\d_]")
_other = re.compile(r"[\W\d_]+")
_factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def has_letter(text: str | None) -> bool:
    return bool(text) and _letter.search(text) is not None


def bucket_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the text's n-grams fall in, sorted, and how many fall in each."""
    total = None
    norm = " " + _other.sub(" ", text).lower() + " "
    for at in range(0, len(norm), CHUNK):
        points = np.frombuffer(norm[max(0, at - ORDERS + 1) : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        skip = at - max(0, at - ORDERS + 1)
        keys = []
        h = np.zeros(len(points), dtype=np.uint64)
        for n in range(ORDERS):
            if len(points) <= n:
                break
            h = h[: len(points) - n] * _factors[0] + (points[n:] + np.uint64(n + 1)) * _factors[1]
            mixed = (h ^ (h >> np.uint64(31))) * _factors[2]
            keys.append((mixed >> np.uint64(64 - bits)).astype(np.int64)[max(0, skip - n) :])
        counts = np.bincount(np.concatenate(keys), minlength=1 << bits)
        total = counts if total is None else total + counts
    used = np.flatnonzero(total)
    return used, total[used]


class Model:
    """Languages (sorted), their log priors and the matrix of log-probabilities."""

    def __init__(self, languages: list[str], documents: np.ndarray, counts: np.ndarray, smoothing: float):
        self.languages = languages
        self.prior = np.log(documents / documents.sum()) if len(languages) else np.zeros(0)
        self.matrix = np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * counts.shape[1])).T.copy() if len(languages) else np.zeros((1, 0))

    def logs(self, texts: list[str]) -> np.ndarray:
        """Joint log-probabilities (texts x languages): the batch's sparse counts times the matrix, in parts of bounded size."""
        bits = int(np.log2(len(self.matrix)))
        counted = [bucket_counts(t, bits) for t in texts]
        out, first, size = np.empty((len(texts), len(self.languages))), 0, 0
        for i, (used, _) in enumerate(counted):
            size += len(used) * len(self.languages)
            if size >= AT_ONCE or i == len(counted) - 1:
                part = counted[first : i + 1]
                starts = np.cumsum([0, *(len(u) for u, _ in part[:-1])])
                products = self.matrix[np.concatenate([u for u, _ in part])] * np.concatenate([n for _, n in part])[:, None]
                out[first : i + 1] = self.prior + np.add.reduceat(products, starts, axis=0)
                first, size = i + 1, 0
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The most probable language of each text and its posterior probability."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        able = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if able:
            logs = self.logs([texts[i] for i in able])
            best = logs.argmax(axis=1)
            sure = 1.0 / np.exp(logs - logs[np.arange(len(able)), best][:, None]).sum(axis=1)
            for i, b, s in zip(able, best.tolist(), sure.tolist(), strict=True):
                out[i] = (self.languages[b], s)
        return out


def train(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", bits: int = BITS, smoothing: float = 0.5) -> Model:
    """Counts over all rows of docs whose language is not null and whose text has a letter."""
    common.small_batches(docs.sparkSession)
    size = 1 << bits

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def rows(lang):
            used = np.flatnonzero(sums[lang])
            return pa.RecordBatch.from_arrays([pa.array([lang] * (len(used) + 1)), pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(sums[lang][used], seen[lang]).astype(np.int64))], names=["lang", "bucket", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    if lang not in sums and len(sums) >= 64:
                        first = next(iter(sums))
                        yield rows(first)
                        del sums[first], seen[first]
                    used, n = bucket_counts(text, bits)
                    sums.setdefault(lang, np.zeros(size, dtype=np.int64))[used] += n
                    seen[lang] = seen.get(lang, 0) + 1
        for lang in sums:
            yield rows(lang)

    narrow = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    summed = narrow.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = common.stored(summed)
    many = summed.where("bucket < 0").count()
    fold = 0
    while fold < bits and many << (bits - fold) > MOST_CELLS:
        fold += 1
    bucket = F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.shiftright("bucket", fold))
    got = summed.groupBy("lang", bucket.cast("int").alias("bucket")).agg(F.sum("n").alias("n")).toArrow()  # at most MOST_CELLS rows, and one a language
    names = np.array(got["lang"].to_pylist(), dtype=object)
    languages = sorted(set(names.tolist()))
    place = {lang: i for i, lang in enumerate(languages)}
    row = np.array([place[n] for n in names], dtype=np.int64)
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    counts, documents = np.zeros((len(languages), size >> fold)), np.zeros(len(languages))
    whole = bucket < 0
    documents[row[whole]] = n[whole]
    counts[row[~whole], bucket[~whole]] = n[~whole]
    return Model(languages, documents, counts, smoothing)


def identify(docs: DataFrame, *, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", held_out: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every document's language, learned from the documents that are not held out and have a language.

    Columns: the id (as doc_id), held_out, lang_pred, score (the posterior probability of lang_pred), then the columns in
    ``keep``.  A text that is null or has no letter is ``und`` with score 0; so is every text when there is nothing to
    learn from.  Documents with a null language are not learned from but predicted.  Ties go to the language that sorts
    first.  Very long texts are counted in pieces, whole.  Repeated rows count as often as they occur; an empty table gives
    an empty result.
    """
    held = held_out if held_out is not None else F.lit(False)
    model = train(docs.where(~held), lang_col=lang_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []
    narrow = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)])

    names = ["doc_id", "held_out", "lang_pred", "score", *narrow.columns[3:]]

    def run(batches):
        for batch in batches:
            found = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), *batch.columns[3:]], names=names)

    types = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = ", ".join([f"doc_id {types['doc_id']}, held_out boolean, lang_pred string, score double", *[f"`{c}` {types[c]}" for c in narrow.columns[3:]]])
    return narrow.mapInArrow(run, schema).toDF("doc_id", "held_out", "lang_pred", "score", *keep)


def query(spark, sf_dir: str) -> DataFrame:
    """Held out: documents whose crc32 of the id, modulo 4, is 2."""
    return identify(common.read(spark, sf_dir, "documents"), held_out=common.crc_fold("doc_id", 4) == 2)
