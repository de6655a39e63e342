"""Comparators, severities, adaptive tolerances, periods, hashes: columns against functions of single values."""

import hashlib
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import compare, periods
from plumbline.functions.hashing import HashPolicy, row_hash, token
from plumbline.functions.severity import AdaptiveRule, SeverityRule, adaptive_columns, determine, highest, severity_column

NOW = datetime(2024, 2, 1)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_aggregate_comparator(spark):
    n = lambda v: F.lit(v).cast("double")
    eq = compare.equal_aggregate
    assert value(spark, eq(n(None), n(0), "number"))
    assert not value(spark, eq(n(1), n(1.1), "number"))
    assert value(spark, eq(n(1), n(1.5), "number", tol_abs=0.5))
    assert value(spark, eq(n(99), n(100), "number", tol_pct=1))
    assert not value(spark, eq(n(98.9), n(100), "number", tol_pct=1))
    assert not value(spark, eq(n(1), n(0), "number", tol_pct=100))
    t = lambda m: F.lit(NOW + timedelta(minutes=m))
    assert value(spark, eq(t(0), t(5), "time", tol_abs=5))
    assert not value(spark, eq(t(0), t(6), "time", tol_abs=5))
    assert value(spark, eq(t(0), t(0), "time"))
    assert not value(spark, eq(t(0), F.lit(None).cast("timestamp"), "time", tol_abs=5))
    assert value(spark, eq(F.lit(" a "), F.lit("a"), "text"))


def test_cell_comparator(spark):
    eq = compare.equal_cell
    d = lambda v: F.lit(v).cast("double")
    assert value(spark, eq(d(None), d(None), ("number", "number")))
    assert value(spark, eq(d(float("nan")), d(None), ("number", "number")))
    assert not value(spark, eq(d(1), d(None), ("number", "number"), tol_abs=100))
    assert value(spark, eq(F.lit("1.0"), d(1), ("text", "number")))
    assert value(spark, eq(F.lit("a"), F.lit("a"), ("text", "text")))
    assert not value(spark, eq(F.lit("a"), F.lit("1"), ("text", "text")))
    assert not value(spark, eq(F.lit(NOW), F.lit(NOW + timedelta(seconds=1)), ("time", "time"), tol_abs=100))


def test_group_and_stat_comparators(spark):
    d = lambda v: F.lit(v).cast("double")
    assert value(spark, compare.equal_group(d(None), d(None)))
    assert not value(spark, compare.equal_group(d(None), d(0)))
    assert not value(spark, compare.equal_stat(d(None), d(1), None, F.lit(100.0)))
    # a percentage of the larger side: 50 is half of 100, on whichever side it stands
    assert value(spark, compare.equal_stat(d(100), d(50), None, F.lit(50.0)))
    assert value(spark, compare.equal_stat(d(50), d(100), None, F.lit(50.0)))


@settings(max_examples=25, deadline=None)
@given(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6), st.one_of(st.none(), st.floats(0, 1e3)), st.one_of(st.none(), st.floats(0, 100)))
def test_number_columns_equal_functions(spark, a, b, tol_abs, tol_pct):
    assert value(spark, compare.within(F.lit(a), F.lit(b), tol_abs, tol_pct)) == compare.close_numbers(a, b, tol_abs, tol_pct)


def test_values_of_custom_sql():
    from decimal import Decimal

    assert compare.equal_values(Decimal("1.0"), 1)
    assert compare.equal_values(NOW, NOW)
    assert compare.equal_values(NOW, NOW + timedelta(seconds=30), tol_min=1)
    assert not compare.equal_values(NOW, NOW + timedelta(seconds=30), tol_sec=10)
    assert compare.equal_values({"a": 1, "b": 2}, {"b": 2, "a": 1})
    assert compare.equal_values(" x", "x ")


def test_severity(spark):
    rules = [SeverityRule("CRITICAL", older_than_days=30, tolerance_pct_exceeded_gte=5), SeverityRule("INFO", tolerance_pct_exceeded_lt=1), SeverityRule("WARNING", reason="missing_target")]
    for context, want in (({"age_days": 30, "pct_diff": 5.0}, "CRITICAL"), ({"age_days": 1, "pct_diff": 0.5}, "INFO"), ({"pct_diff": 3.0}, "WARNING"), ({}, "WARNING")):
        assert determine(context, rules) == want
        cols = {k: F.lit(context.get(k)).cast("double") for k in ("age_days", "pct_diff", "abs_diff")} | {"reason": F.lit(context.get("reason")).cast("string")}
        assert value(spark, severity_column(cols, rules)) == want
    assert highest("INFO", None, "CRITICAL", "WARNING") == "CRITICAL"
    assert highest(None) is None


def test_adaptive_tolerances(spark):
    rules = [AdaptiveRule("last_hours", hours=48, tolerance_pct=10), AdaptiveRule("older_than_days", days=30, tolerance_abs=1, tolerance_pct=0.1)]
    for hours, want in ((1, (5.0, 10.0)), (48, (5.0, 10.0)), (49, (5.0, 2.0)), (24 * 30, (1, 0.1)), (-5, (5.0, 10.0))):
        a, p = adaptive_columns(F.lit(hours * 3600.0), 5.0, 2.0, rules)
        assert (value(spark, a), value(spark, p)) == want
    a, p = adaptive_columns(F.lit(None).cast("double"), 5.0, None, rules)
    assert (value(spark, a), value(spark, p)) == (5.0, None)
    assert [value(spark, c) for c in adaptive_columns(F.lit(1.0), 5.0, 2.0, [])] == [5.0, 2.0]
    with pytest.raises(ValueError):
        AdaptiveRule("last_hours", days=2)


def test_periods(spark):
    row = lambda g, t: spark.range(1).select(periods.key_of(g, periods.start_of(g, F.lit(t))).alias("k"), periods.end_of(g, periods.start_of(g, F.lit(t))).alias("e")).first()
    t = datetime(2024, 12, 31, 13)
    assert row("week", t) == ("2025-W01", datetime(2025, 1, 6))
    assert row("month", t) == ("2024-12", datetime(2025, 1, 1))
    assert row("day", t)["k"] == "2024-12-31" and row("year", t)["k"] == "2024"
    assert periods.lookback(datetime(2024, 3, 31), months=1) == datetime(2024, 2, 29)
    assert periods.lookback(NOW) is None
    assert periods.lookback(NOW, weeks=1) == datetime(2024, 1, 25)


@pytest.mark.parametrize("algorithm", ["double_md5", "md5_row", "sha256_row"])
@pytest.mark.parametrize("case", ["none", "lower", "upper"])
def test_hashes(spark, algorithm, case):
    rows = [(1, "Alice", 10.5), (2, "Bob", None), (3, "ALICE", 7.1)]
    df = spark.createDataFrame(rows, "id long, name string, amount double")
    got = [r["h"] for r in df.select(row_hash(df, ["id", "name", "amount"], HashPolicy(algorithm, "<Null>", "|", case)).alias("h")).collect()]
    fold = {"none": str, "lower": str.lower, "upper": str.upper}[case]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    for r, h in zip(rows, got, strict=True):
        tokens = [fold("<Null>" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)) for v in r]
        joined = "|".join(md5(t) for t in tokens) if algorithm == "double_md5" else "|".join(tokens)
        assert h == (hashlib.sha256(joined.encode()).hexdigest() if algorithm == "sha256_row" else md5(joined))


def test_texts_of_doubles(spark):
    """Unequal doubles have unequal texts, whatever their size."""
    import math

    values = [1e-8, 2e-7, 1.5e-8, 0.1, 0.1234567, 0.1234568, 1e40, 2e40, 123456.75, float("nan"), float("inf"), -float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(token(F.col("v"), T.DoubleType(), HashPolicy(null_token="<null>", case="none"))).collect()]
    assert len(set(got)) == len(values) and got[0] == "1e-8" and got[3] == "0.100000" and got[6] == "1e40" and got[-1] == "<null>"
    assert all(math.isnan(v) or float(t) == v for v, t in zip(values[:-1], got, strict=False))
    narrow = spark.createDataFrame([(0.1,)], "v float").select(token(F.col("v"), T.FloatType(), HashPolicy())).first()[0]
    assert narrow == "0.100000"
