"""A corpus pipeline: language ID, near-duplicate removal, masking of personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet to the shared
folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, jaccard_join, langid, mixing, packing, pii

#: Documents whose predicted language is less probable than this are rejected, as are those without letters.
LEAST_SCORE = 0.5


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; lang stays as it is, or becomes the prediction where it was null."""
    found = langid.identify(docs, keep=docs.columns)
    kept = found.toDF("__id", "__held", "__pred", "__score", *[f"__{i}" for i in range(len(docs.columns))])
    kept = kept.where((F.col("__pred") != langid.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE))
    value = lambda i, c: F.coalesce(F.col(f"__{i}"), F.col("__pred")) if c == "lang" else F.col(f"__{i}")
    return kept.select(*[value(i, c).alias(c) for i, c in enumerate(docs.columns)])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8."""
    return jaccard_join.one_of_each(docs, shingle_words=5, share=(80, 100))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in random order."""
    return mixing.mix(docs, temperature=0.5, total=1.0, seed=17).drop("copy", "shuffle_key")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.pack(docs, window=1024)


STAGES = [
    ("language_id", identified),
    ("jaccard_join", deduplicated),
    ("pii", masked),
    ("mixing", mixed),
    ("packing", packed),
]

#: No SQL can express the trained first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
