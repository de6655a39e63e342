"""Mixing of sources to target weights: Poisson replication.

A source's repetition rate is its target share of the mixture over its share of the corpus.  Each document draws its
number of copies from a Poisson distribution of that mean, by inverting the distribution at a uniform number hashed from
a seed and the document's id; copies are then shuffled globally by a hash of seed, id and copy.  All of it is SQL, so the
draw is the same for every run, partitioning and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Means above this are drawn as a sum of independent draws of smaller means, which keeps exp(-mean) far from underflow.
STEP = 8.0
#: Terms of the inversion; the probability of more at a mean of STEP is below 1e-30.
TERMS = 64


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of an md5: exact in double precision."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def poisson(mean: Column, u: Column) -> Column:
    """The smallest k whose cumulative probability reaches u: one pass over the terms p, p * mean / 1, ..."""
    first = F.exp(-mean)
    start = F.struct(F.lit(0).cast("long").alias("k"), first.alias("p"), first.alias("c"))
    step = lambda s, i: F.when(s["c"] >= u, s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["k"])


def rates(docs: DataFrame, *, source_col: str, size_col: Column, weights: dict[str, float] | None, temperature: float, total: float) -> DataFrame:
    """source, size, rate: a row a source.  Without weights a source's target share goes as its size ** temperature."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).cast("double").alias("size"))
    if weights is None:
        wanted = F.when(F.col("size") > 0, F.pow("size", F.lit(temperature))).otherwise(0.0)
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        wanted = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    all_rows = Window.partitionBy()
    share = sizes.withColumn("wanted", wanted)
    rate = F.col("wanted") / F.sum("wanted").over(all_rows) * F.sum("size").over(all_rows) * total / F.col("size")
    return share.select("source", "size", F.when((F.col("size") > 0) & (F.col("wanted") > 0), rate).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.5, total: float = 1.0, seed: int = 17) -> DataFrame:
    """docs with every document repeated (or left out) by its source's rate, in a global random order.

    ``weights`` maps sources to target weights (sources not named get none); without it the target share of a source goes
    as its number of characters to the power ``temperature``.  ``total`` is the mixture's size over the corpus's.  Added
    columns: copy (from 0), shuffle_key (the order of the result; partitions are sorted by it).  The expected size of each
    source in the mixture is its target share.

    A null source is a source of its own (with ``weights``, one without weight).  Null and empty texts have size 0 and take
    their source's rate; a source without any characters is left out.  Rows with the same id draw the same count, so
    repeated rows are repeated alike; a null id draws as the empty text.  An empty table stays empty.  Columns named copy
    or shuffle_key are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    names = docs.columns
    at = lambda c: f"c{[x.lower() for x in names].index(c.lower())}"
    docs, id_col, source_col, text_col = docs.toDF(*(f"c{i}" for i in range(len(names)))), at(id_col), at(source_col), at(text_col)
    size = F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long")
    rate = rates(docs, source_col=source_col, size_col=size, weights=weights, temperature=temperature, total=total)
    rate = rate.withColumn("steps", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    rate = rate.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), F.col("steps").alias("__steps"))
    # a row a source: the rates are sent to every task only if their counted size is small
    rate = common.stored(rate)
    with_rate = docs.join(common.small_side(rate, 64), F.col(source_col).eqNullSafe(F.col("__source")), "inner")
    draws = F.transform(F.sequence(F.lit(1), F.col("__steps")), lambda i: poisson(F.col("__rate") / F.col("__steps"), uniform(F.lit(seed), F.lit("count"), F.col(id_col), i)))
    n = F.aggregate(draws, F.lit(0).cast("long"), lambda a, b: a + b)
    copies = with_rate.withColumn("__n", n).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy")))
    out = copies.select(*docs.columns, "copy", key.alias("shuffle_key")).toDF(*names, "copy", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents"), temperature=0.5, total=1.0, seed=17)


ORACLE_SQL = f"""
WITH RECURSIVE size AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source
), wanted AS (
  SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.5) ELSE 0.0 END AS wanted FROM size
), rate AS (
  SELECT source, CASE WHEN size > 0 AND wanted > 0 THEN wanted / (SELECT sum(wanted) FROM wanted) * (SELECT sum(size) FROM wanted) / size ELSE 0.0 END AS rate
  FROM wanted
), steps AS (
  SELECT source, rate, CAST(greatest(1, ceil(rate / {STEP})) AS BIGINT) AS steps FROM rate
), drawn AS (
  SELECT d.*, rate / steps AS mean, u.i AS draw,
         (CAST(concat('0x', substr(md5(concat('17:count:', coalesce(CAST(d.doc_id AS VARCHAR), ''), ':', u.i)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source, LATERAL (SELECT unnest(generate_series(1, steps)) AS i) u
), counted AS (
  SELECT doc_id, text, lang, source, n_chars, draw, mean, u, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM drawn
  UNION ALL
  SELECT doc_id, text, lang, source, n_chars, draw, mean, u, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM counted WHERE c < u AND k < {TERMS}
), copies AS (
  SELECT doc_id, text, lang, source, n_chars, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT doc_id, text, lang, source, n_chars, draw, max(k) AS k FROM counted GROUP BY ALL) GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy, md5(concat('17:order:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', copy)) AS shuffle_key
FROM (SELECT *, unnest(generate_series(0, n - 1)) AS copy FROM copies WHERE n > 0)
"""
