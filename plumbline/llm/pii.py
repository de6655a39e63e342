"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Everything is SQL on the JVM side.  ``regexp_extract_all`` gives a pattern's matches and ``split`` by the same pattern the
text between them; a match's place is the sum of the lengths before it.  Sums run over blocks, so a text with very many
matches costs little more than its length.  Patterns are written so that matching takes time in proportion to the text:
runs are possessive and start only where a run starts, which gives the matches of the plain patterns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters before and after a match that are searched for context words.
CONTEXT = 48
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """What to propose, where to look at all (guard), and how sure a confirmed match is.

    plain is the pattern's meaning; fast gives the same matches in linear time.  Base kinds are reported whatever their
    score, the others from ``threshold`` on.  context maps a pattern of nearby words to what it adds to the score.
    """

    name: str
    plain: str
    guard: str
    score: float
    base: bool = False
    fast: str = ""
    context: dict[str, float] = field(default_factory=dict)


_RUN = r"[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@", 0.9, True, rf"(?:(?<!{_RUN})|\G){_RUN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", {r"(?i)e-?mail|contact|write to": 0.1}),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]\.[0-9]", 0.6, True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", {r"(?i)address|host|server|login": 0.3, r"(?i)version|release|section": -0.3}),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", 0.8, True, r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+", {r"(?i)card|visa|payment|credit": 0.2, r"(?i)order|serial|tracking": -0.3}),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, True, "", {r"(?i)phone|call|tel|mobile|fax": 0.3}),
    Kind("iban", r"[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|(\x20[A-Z0-9]{4}){2,7}(\x20[A-Z0-9]{1,3})?)", r"[A-Z]{2}[0-9]{2}", 0.9, context={r"(?i)iban|account|bank|transfer": 0.1}),
    Kind("national_id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9][0-9]-[0-9]", 0.3, context={r"(?i)ssn|social security|national id|tax": 0.5}),
)
THRESHOLD = 0.7
#: Whether a match of these kinds may touch letters or digits on either side.
WHOLE = {"iban", "national_id"}


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column) -> Column:
    """The sums of all prefixes of an array column, by blocks."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    n = F.size(values)
    blocks = lambda: F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / BLOCK)).cast("int"))
    sums = F.transform(blocks(), lambda b: total(F.slice(values, b * BLOCK + 1, BLOCK)))
    before = let(sums, lambda s: F.transform(blocks(), lambda b: F.when(b == 0, 0).otherwise(total(F.slice(s, F.lit(1), b)))))
    return let(before, lambda p: F.transform(values, lambda v, i: p[F.floor(i / BLOCK).cast("int")] + total(F.slice(values, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether up to 20 digits pass the Luhn checksum."""
    padded = F.lpad(number, 20, "0")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    digit = lambda i: F.substring(padded, i + 1, 1).cast("int")
    return sum((doubled(digit(i)) if i % 2 == 0 else digit(i) for i in range(20)), F.lit(0)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number's rearranged digits leave 1 on division by 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(plain.substr(F.lit(5), F.lit(99)), plain.substr(F.lit(1), F.lit(4)))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def confirmed(kind: str, value: Column, before: Column, after: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    n = F.length(digits(value))
    rule = {
        "ip": lambda: value.rlike(rf"^{part}\.{part}\.{part}\.{part}$"),
        "card": lambda: F.when(n.between(16, 19), luhn(digits(value))).otherwise(False),
        "phone": lambda: n.between(8, 15),
        "iban": lambda: F.when(F.length(F.regexp_replace(value, " ", "")).between(15, 34), mod97(value)).otherwise(False),
        "national_id": lambda: ~value.rlike("^(?:000|666|9..)-|-00-|-0000$"),
    }.get(kind, lambda: F.lit(True))()
    if kind in WHOLE:
        rule = rule & ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
    return rule


def score(kind: Kind, before: Column, after: Column) -> Column:
    around = F.concat(before, F.lit(" "), after)
    total = F.lit(kind.score)
    for words, add in kind.context.items():
        total = total + F.when(around.rlike(words), add).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def accepted(kind: Kind, value: Column, before: Column, after: Column) -> Column:
    ok = confirmed(kind.name, value, before, after)
    return ok if kind.base else ok & (score(kind, before, after) >= THRESHOLD)


def guarded(text: Column, kind: Kind) -> Column:
    return F.contains(text, F.lit(kind.guard)) if kind.guard == "@" else text.rlike(kind.guard)


def parts(text: Column, kind: Kind, body) -> Column:
    """body(matches, gaps): a pattern's matches and the text around them (one gap more than matches)."""
    pattern = kind.fast or kind.plain
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda g: body(m, g)))


SPAN = "struct<kind:string,start:int,end:int,value:string,score:double>"


def spans_of(text: Column, kind: Kind) -> Column:
    """A kind's accepted spans in a text: array of kind, start, end (code points, end exclusive), value, score."""

    def body(matches: Column, gaps: Column) -> Column:
        ends = running(F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))))

        def one(e: Column):
            return lambda m, i: F.struct(m.alias("value"), e[i].alias("end"), F.right(gaps[i], F.lit(CONTEXT)).alias("before"), F.left(gaps[i + 1], F.lit(CONTEXT)).alias("after"))

        all_ = let(ends, lambda e: F.transform(matches, one(e)))
        good = F.filter(all_, lambda s: accepted(kind, s["value"], s["before"], s["after"]))
        return F.transform(good, lambda s: F.struct(F.lit(kind.name).alias("kind"), (s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value"), score(kind, s["before"], s["after"]).alias("score")))

    return F.when(guarded(text, kind), parts(text, kind, body)).otherwise(F.array().cast(f"array<{SPAN}>"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and spans: all accepted spans of a text, by kind in the order of ``kinds``, then by start.

    Matches of a kind are the leftmost ones that don't overlap; those that fail their check are dropped without a retry.
    Spans of different kinds may overlap.  A null or empty text has no spans.  Null ids and repeated rows are documents
    like any other, an empty table gives an empty result, further columns are ignored.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    return narrow.select("doc_id", F.concat(*[spans_of(text, k) for k in kinds]).alias("spans"))


def masked(text: Column, kind: Kind) -> Column:
    def body(matches: Column, gaps: Column) -> Column:
        shown = lambda m, i: F.when(accepted(kind, m, F.right(gaps[i], F.lit(CONTEXT)), F.left(gaps[i + 1], F.lit(CONTEXT))), F.lit(f"<{kind.name.upper()}>")).otherwise(m)
        return let(F.transform(matches, shown), lambda s: F.array_join(F.zip_with(gaps, s, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), ""))

    return F.when(guarded(text, kind), parts(text, kind, body)).otherwise(text)


def redact(docs: DataFrame, *, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every accepted span of text_col replaced by its kind in angle brackets, one kind after the other.

    Null texts stay null; all other columns and rows stay as they are.
    """
    out = docs
    for kind in kinds:
        out = out.withColumn(text_col, masked(F.col(text_col), kind))
    return out


def digest(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts by base kind, the base spans' checksum and all spans as text."""
    base = [k.name for k in kinds if k.base]
    of = lambda name: F.filter("spans", lambda s: s["kind"] == name)
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[F.size(of(n)).cast("long").alias(f"n_{n}") for n in base], F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(find(common.read(spark, sf_dir, "documents")))


def _sql_kind(kind: Kind) -> str:
    """DuckDB SQL for the spans of a kind: the plain pattern, positions by running sums of list lengths."""
    part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    digit = "regexp_replace(value, '[^0-9]', '', 'g')"
    luhn_sum = f"(SELECT sum(CASE WHEN i % 2 = 1 THEN (CASE WHEN c > 4 THEN c * 2 - 9 ELSE c * 2 END) ELSE c END) FROM (SELECT i, CAST(substr(lpad({digit}, 20, '0'), i, 1) AS INT) AS c FROM generate_series(1, 20) t(i)))"
    rule = {
        "ip": rf"regexp_full_match(value, '{part}\.{part}\.{part}\.{part}')",
        "card": f"length({digit}) BETWEEN 16 AND 19 AND {luhn_sum} % 10 = 0",
        "phone": f"length({digit}) BETWEEN 8 AND 15",
        "iban": "length(replace(value, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, [CASE WHEN ascii(c) >= 65 THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END for c in string_split(concat(substr(replace(value, ' ', ''), 5), substr(replace(value, ' ', ''), 1, 4)), '')]), lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1",
        "national_id": "NOT regexp_matches(value, '^(000|666|9..)-|-00-|-0000$')",
    }.get(kind.name, "true")
    if kind.name in WHOLE:
        rule += " AND NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]')"
    if not kind.base:
        total = " + ".join([str(kind.score), *(f"CASE WHEN regexp_matches(concat(before, ' ', after), '{w}') THEN {a} ELSE 0 END" for w, a in kind.context.items())])
        rule += f" AND least(1.0, {total}) >= {THRESHOLD}"
    return rf"""
  SELECT row, '{kind.name}' AS kind, start, stop FROM (
    SELECT row, m[i] AS value, right(g[i], {CONTEXT}) AS before, left(g[i + 1], {CONTEXT}) AS after,
           CAST(coalesce(list_sum([length(x) for x in g[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS BIGINT) AS start,
           CAST(coalesce(list_sum([length(x) for x in g[1:i]]), 0) + coalesce(list_sum([length(x) for x in m[1:i]]), 0) AS BIGINT) AS stop
    FROM (SELECT row, m, g, unnest(generate_series(1, len(m))) AS i
          FROM (SELECT row, regexp_extract_all(text, '{kind.plain}') AS m, string_split_regex(text, '{kind.plain}') AS g FROM d WHERE regexp_matches(text, '{kind.guard}'))))
  WHERE {rule}"""


_BASE = [k.name for k in KINDS if k.base]
_ORDER = "CASE kind " + " ".join(f"WHEN '{k.name}' THEN {i}" for i, k in enumerate(KINDS)) + " END"
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_sql_kind(k) for k in KINDS)}),
joined AS (
  SELECT row, {", ".join(f"count(*) FILTER (WHERE kind = '{b}') AS n_{b}" for b in _BASE)},
         string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY {_ORDER}, start) FILTER (WHERE kind IN ({", ".join(f"'{b}'" for b in _BASE)})) AS base,
         string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY {_ORDER}, start) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{b}, 0) AS n_{b}" for b in _BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (row)
"""
