"""Quality rules: decision lists learned by sequential covering.

Statistics of whole texts are SQL expressions.  Rules are conjunctions of thresholds on them, learned from labelled
documents: a rule is grown condition by condition on one part of the labelled rows (by information gain on the
documents that it covers), pruned from its end on the other part, and kept if it is precise there; what it covers is put
aside and the next rule is learned.  The list becomes one ordered conditional expression, evaluated with the statistics
in the scan.

Learning takes at most ``sample`` labelled rows, those of smallest hash, whose statistics (a few numbers each) are
collected; statistics and verdicts are computed for all rows of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .pii import let

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Labelled rows to learn from, at most.
SAMPLE = 20_000
FEATURES = ("n_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "marks_per_word")


def repeat_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more, the first included."""
    grams = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        starts = let(placed, lambda s: F.filter(F.transform(s, lambda x, j: F.when(F.coalesce(F.get(s, j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False)), x["i"])), lambda i: i.isNotNull()))
        add = lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n"))
        return F.aggregate(F.sort_array(starts), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda a: a["n"])

    some = lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))
    hashed = lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(grams(h), some))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, hashed))


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks (long).

    Words are parted by ASCII white space.  A null text counts as an empty one: all counts are 0.
    """
    t = F.col("__t")
    without = lambda chars: F.length(F.translate(t, chars, ""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    split = narrow.select("doc_id", "__t", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("__w"), F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "").alias("__l"))
    counts = {
        "n_words": F.size("__w"),
        "word_chars": without(BLANKS),
        "n_symbols": F.length(t) - without(SYMBOLS),
        "n_lines": F.size("__l"),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": repeat_words(F.col("__w")),
        "n_upper": F.length(t) - without(common.UPPER),
        "n_marks": F.length(t) - without("!?"),
    }
    return split.select("doc_id", *[c.cast("long").alias(name) for name, c in counts.items()])


def features() -> dict[str, Column]:
    """The rules' features, from the columns of statistics()."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.threshold if self.above else table[self.feature] <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


def _covers(rule: list[Condition], table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), dtype=bool)
    for c in rule:
        out &= c.holds(table)
    return out


def grow(table: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int, barred: frozenset[str] = frozenset()) -> list[Condition]:
    """A conjunction that covers bad rows and few others: the condition of largest information gain at a time."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for feature in FEATURES:
            if not rule and feature in barred:
                continue
            x = table[feature][inside]
            edges = np.unique(np.quantile(x, np.linspace(0, 1, cuts + 1)[1:-1]))
            for above in (True, False):
                for t in edges:
                    hit = x > t if above else x <= t
                    p1, n1 = (bad[inside] & hit).sum(), (~bad[inside] & hit).sum()
                    if p1:
                        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = Condition(feature, above, float(t)), g
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(table)
    return rule


def centred(rule: list[Condition], table: dict[str, np.ndarray]) -> list[Condition]:
    """The rule with each threshold moved to the middle of the gap between the values on its two sides."""
    out = []
    for c in rule:
        x = table[c.feature]
        low, high = x[x <= c.threshold], x[x > c.threshold]
        out.append(Condition(c.feature, c.above, float((low.max() + high.min()) / 2)) if len(low) and len(high) else c)
    return out


def prune(rule: list[Condition], table: dict[str, np.ndarray], bad: np.ndarray, precision: float, least: int) -> list[Condition]:
    """The beginning of the rule that does best on rows it wasn't grown on, (bad - others) / covered, of those precise there."""
    worth = {}
    for k in range(1, len(rule) + 1):
        hit = _covers(rule[:k], table)
        if hit.sum() >= least and bad[hit].mean() >= precision:
            worth[k] = ((2 * bad[hit].sum() - hit.sum()) / hit.sum(), bad[hit].sum(), -k)
    return rule[: max(worth, key=worth.get)] if worth else []


def learn(table: dict[str, np.ndarray], bad: np.ndarray, *, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.97, least: int = 3, cuts: int = 64) -> list[list[Condition]]:
    """Sequential covering: rules for bad rows, in order.  Every third row is for pruning.

    A rule that isn't precise, on the rows for pruning or on all that it covers, is dropped, and no further rule begins
    with the feature that it began with until another rule has been found.
    """
    check = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), dtype=bool)
    rules: list[list[Condition]] = []
    barred: set[str] = set()
    while len(rules) < most_rules and len(barred) < len(FEATURES):
        a, b = left & ~check, left & check
        if not bad[a].any() or not bad[b].any():
            break
        part = lambda mask: {k: v[mask] for k, v in table.items()}
        grown = grow(part(a), bad[a], most_conditions, cuts, frozenset(barred))
        if not grown:
            break
        rule = prune(grown, part(b), bad[b], precision, least)
        if len(rule) < len(grown) and (not rule or bad[_covers(rule, table) & left].mean() < precision):
            rule = grown  # the whole rule may be precise where its beginning is not
        hit = _covers(rule, table) & left if rule else np.zeros(len(bad), dtype=bool)
        if not hit.any() or bad[hit].mean() < precision:
            barred.add(grown[0].feature)
            continue
        rules.append(centred(rule, table))
        left &= ~hit
        barred = set()
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> list[list[Condition]]:
    """Rules for documents labelled 0, from at most ``sample`` labelled rows (those whose ids hash smallest)."""
    picked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null")
    picked = picked.orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample)  # bounded, so it may be broadcast
    ids = docs.join(F.broadcast(picked), F.col(id_col) == F.col("__id"), "left_semi")
    rows = statistics(ids, id_col=id_col, text_col=text_col).join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("__id", "__label", *[c.alias(n) for n, c in features().items()])
    found = sorted(tuple(r) for r in rows.orderBy(F.xxhash64("__id"), "__id").limit(sample).collect())
    if not found:
        return []
    order = np.random.default_rng(5).permutation(len(found))
    values = np.array([r[1:] for r in found], dtype=np.float64)[order]
    return learn({name: values[:, i + 1] for i, name in enumerate(FEATURES)}, values[:, 0] == 0)


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional: the first rule that holds rejects; without one the text is kept."""
    out = None
    for rule in rules:
        both = rule[0].column()
        for c in rule[1:]:
            both = both & c.column()
        out = F.when(both, False) if out is None else out.when(both, False)
    return out.otherwise(True) if out is not None else F.lit(True)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The statistics of every document, base_failed (under 50 words, or over half of them repeated) and kept.

    kept is false for base_failed, else the verdict of the rules learned from labels.  Labels other than 0 and 1 and
    labelled ids without a document are ignored; without both kinds of labels there are no rules.  Null and empty texts
    have no words and fail.  Repeated rows get equal rows; an empty table gives an empty result; further columns of either
    table are ignored.
    """
    rules = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    counts = statistics(docs, id_col=id_col, text_col=text_col)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return counts.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
