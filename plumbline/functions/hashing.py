"""Row hashes that are the same for equal rows on both sides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALGORITHMS = ("double_md5", "md5_row", "sha256_row")
CASES = ("none", "lower", "upper")


@dataclass(frozen=True)
class HashPolicy:
    """How values become text and rows become hashes."""

    algorithm: str = "double_md5"
    null_token: str = ""
    delimiter: str = "|"
    case: str = "upper"
    #: The type whose text floating-point values have where it holds them exactly; engines print them differently otherwise.
    number_type: str = "decimal(38,6)"

    def __post_init__(self):
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown hash algorithm {self.algorithm!r}; one of {', '.join(ALGORITHMS)}")
        if self.case not in CASES:
            raise ValueError(f"unknown case {self.case!r}; one of {', '.join(CASES)}")


def number_text(column: Column, data_type: T.DataType, number_type: str) -> Column:
    """A floating-point value's text: that of number_type if the value comes back from it unchanged; else NaN, Infinity,
    -Infinity, or the shortest digits that give the value back, with an exponent as in 1.5e-8.  Unequal values have unequal
    texts, but for 0.0 and -0.0."""
    fixed = column.try_cast(number_type)
    text = column.cast("string")
    digits = F.regexp_replace(F.regexp_replace(text, "\\.0(E|$)", "$1"), "E", "e")
    return F.when(fixed.cast(data_type) == column, fixed.cast("string")).when(F.isnan(column) | (F.abs(column) == float("inf")), text).otherwise(digits)


def token(column: Column, data_type: T.DataType, policy: HashPolicy) -> Column:
    """A value's text: NULL becomes the null token, then the case is folded."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        column = number_text(column, data_type, policy.number_type)
    text = F.coalesce(column.cast("string"), F.lit(policy.null_token))
    return {"none": lambda c: c, "lower": F.lower, "upper": F.upper}[policy.case](text)


def row_hash(df: DataFrame, columns: list[str], policy: HashPolicy | None = None) -> Column:
    """The hash of the named columns, in their order: lower-case hexadecimal digits."""
    policy = policy or HashPolicy()
    tokens = [token(F.col(f"`{c}`"), df.schema[c].dataType, policy) for c in columns]
    if policy.algorithm == "double_md5":
        return F.md5(F.concat_ws(policy.delimiter, *[F.md5(t) for t in tokens]))
    joined = F.concat_ws(policy.delimiter, *tokens)
    return F.md5(joined) if policy.algorithm == "md5_row" else F.sha2(joined, 256)
