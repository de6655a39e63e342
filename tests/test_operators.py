"""Checks as plans: a pass and a failure of each, NULL and duplicate keys, empty sides; sampling against literal loops."""

import random
from datetime import datetime

import pytest

from plumbline.operators import columns, counts, custom_sql, expectations, rows, sampling, stats
from plumbline.operators.counts import Rule
from plumbline.sources.sides import align, latest_per_key, sanitize, split_list
from plumbline.sources.uri import engine_of, jdbc_url, path_of


@pytest.fixture(scope="module")
def two(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 3.0), (4, None, 4.0), (4, None, 4.0)], "id long, name string, v double")
    t = spark.createDataFrame([(1, "a", 1.2), (3, "c", 2.0), (None, "n", 3.0), (4, None, 4.0)], "id long, name string, v double")
    return s, t


def test_row_count(spark, two):
    s, t = two
    assert tuple(counts.row_count(s, s).first()) == (5, 5, "PASS")
    assert tuple(counts.row_count(s, t).first()) == (5, 4, "FAIL")
    assert tuple(counts.row_count(s.limit(0), t.limit(0)).first()) == (0, 0, "PASS")


def test_aggregations(two):
    s, t = two
    rules = [Rule("count"), Rule("sum", "v", "v", tolerance_pct=50), Rule("distinct_count", "name", "name"), Rule("distinct_count", "id", "id"), Rule("max", "name", "name"), Rule("avg", "v", "v", 0.5)]
    got = {r["rule_idx"]: r for r in counts.aggregations(s, t, rules).collect()}
    assert [got[i]["pass"] for i in range(6)] == [False, True, True, True, True, True]
    assert (got[0]["source"], got[0]["target"]) == (5, 4) and got[4]["source_text"] == "n"
    empty = counts.aggregations(s.limit(0), t.limit(0), [Rule("sum", "v", "v"), Rule("count")]).collect()
    assert all(r["pass"] for r in empty)
    with pytest.raises(ValueError):
        counts.aggregations(s, t, [])
    with pytest.raises(ValueError):
        Rule("sum")


def test_groups(two):
    s, t = two
    got = {r["p"]: r["pass"] for r in counts.group_aggregations(s, t, None, "name", "name").collect()}
    assert got == {"a": True, "b": False, "c": False, "n": True, None: False}
    assert [r["p"] for r in counts.differing(counts.partitions(s, t, "name", "name"), 2).collect()] == [None, "b"]


def test_hash_diff_is_of_sets(two):
    s, t = two
    assert tuple(rows.hash_diff(s, s.distinct(), ["id", "name", "v"]).first()) == (0, 0, "PASS")
    assert tuple(rows.hash_diff(s, t, ["id", "name"]).first()) == (1, 1, "FAIL")


def test_rowdiff(two):
    s, t = two
    d = rows.RowDiff(s, t, ["id"], ["name", "v"])
    assert tuple(d.summary().first()) == (1, 1, 1, 1, "FAIL")
    assert [r["id"] for r in d.missing().collect()] == [2] and [r["id"] for r in d.extra().collect()] == [3]
    assert [tuple(r) for r in d.cells().collect()] == [(1, "v", "1.0", "1.2")]
    # NULL keys match, and the key 4, twice on one side, gives two pairs
    assert d.joined.where("in_source and in_target").count() == 4
    loose = rows.RowDiff(s, t, ["id"], ["v"], rows.Tolerance(pct=0), {"v": rows.Tolerance(abs=0.25)})
    assert loose.cells().count() == 0
    assert rows.RowDiff(s, s.distinct(), ["id"], ["name"]).summary().first()["status"] == "PASS"


def test_domain(spark):
    df = spark.createDataFrame([("Y",), ("N",), (None,), ("it's",)], "c string")
    bad = lambda **kw: columns.domain(df, "c", **kw).first()["invalid_count"]
    assert bad(allowed=["Y", "N"]) == 1
    assert bad(allowed=["Y", "N", None]) == 1
    assert bad(allowed=["it's"]) == 2
    assert bad(excluded=[None]) == 1
    assert bad(excluded=["Y", None]) == 2
    assert bad(regex="^[YN]$") == 1
    assert bad() == 0
    assert columns.domain(df, "c", allowed=["Y", "N"], tolerance_pct=25).first()["status"] == "PASS"
    assert tuple(columns.domain(df.limit(0), "c", allowed=[]).first()) == (0, 1, 0.0, "PASS")


def test_freshness(spark):
    now = datetime(2024, 1, 2)
    df = spark.createDataFrame([(datetime(2024, 1, 1, 23),)], "t timestamp_ntz")
    assert tuple(columns.freshness(df, "t", 60, now).first())[1:] == (60.0, "PASS")
    assert columns.freshness(df, "t", 59.9, now).first()["status"] == "FAIL"
    assert columns.freshness(df.limit(0), "t", 60, now).first()["status"] == "FAIL"


def test_schema_drift(spark):
    s = spark.createDataFrame([], "a int, B string, c float")
    t = spark.createDataFrame([], "A int, b string, c double, d int")
    found = lambda **kw: {(r["kind"], r["column"]) for r in columns.schema_drift(s, t, **kw).collect()}
    assert found() == {("type", "c"), ("extra_on_target", "d")}
    assert ("missing_on_target", "a") in found(case_sensitive=True)
    assert ("missing_expected", "z") in found(expected=["z", "a"])


def test_custom_sql():
    assert custom_sql.single(True) and not custom_sql.single(False) and not custom_sql.single(None)
    assert custom_sql.single(0) and not custom_sql.single(3) and custom_sql.single(3, 4, tol_abs=1)
    assert custom_sql.single("ok") and not custom_sql.single(" FAIL ") and custom_sql.single("x", "x ")
    assert custom_sql.single(datetime(2024, 1, 1), "2024-01-01")
    assert custom_sql.dual(2, 1, "greater") and custom_sql.dual(1, 2, "less") and not custom_sql.dual(None, 1, "less")
    with pytest.raises(ValueError):
        custom_sql.dual(1, 1, "near")


def chunk_loop(s, t, lo, hi, size, most):
    out, at, n = [], lo, 0
    while at <= hi and n < most:
        end = min(hi, at + size - 1)
        a, b = (sum(at <= x <= end for x in side) for side in (s, t))
        if a != b:
            out.append((at, end, a, b, a - b))
        at, n = end + 1, n + 1
    return out, at <= hi


def halving(s, t, lo, hi, depth, most):
    out, seen, cut = [], 0, False

    def go(a, b, d):
        nonlocal seen, cut
        if seen >= most:
            cut = True
            return
        seen += 1
        x, y = (sum(a <= v <= b for v in side) for side in (s, t))
        if x == y:
            return
        if d >= depth or a == b:
            out.append((a, b, x, y, x - y))
            return
        go(a, (a + b) // 2, d + 1)
        go((a + b) // 2 + 1, b, d + 1)

    go(lo, hi, 1)
    return out, cut


@pytest.mark.parametrize("seed", range(4))
def test_ranges_against_loops(spark, seed):
    rng = random.Random(seed)
    s = [rng.randint(-50, 400) for _ in range(120)]
    t = [x for x in s if rng.random() > 0.06] + [rng.randint(-50, 450) for _ in range(5)]
    frames = [spark.createDataFrame([(x,) for x in side] + [(None,)], "id long") for side in (s, t)]
    lo, hi = min(s + t), max(s + t)
    for most in (3, 100):
        got = sampling.mismatch_ranges(*frames, "id", "id", sampling.Sampling("chunk", chunk_size=37, max_scan_chunks=most))
        want, cut = chunk_loop(s, t, lo, hi, 37, most)
        assert sorted(map(tuple, got.df.collect())) == want and got.truncated == cut
        for depth in (1, 4, 14):
            got = sampling.mismatch_ranges(*frames, "id", "id", sampling.Sampling("binary", max_depth=depth, max_scan_chunks=most))
            want, cut = halving(s, t, lo, hi, depth, most)
            assert sorted(map(tuple, got.df.collect())) == sorted(want) and got.truncated == cut


def test_ranges_without_ids(spark):
    text = spark.createDataFrame([("x",)], "id string")
    assert sampling.mismatch_ranges(text, text, "id", "id", sampling.Sampling("chunk")) is None
    with pytest.raises(ValueError):
        sampling.Sampling("chunk", chunk_size=0)


def test_stats_compare(spark):
    row = lambda side, key, value, at=1: ("r", None, "t", side, "ts", "day", datetime(2024, 1, int(key[-2:])), datetime(2024, 1, int(key[-2:])), key, "count:*", None, value, 1, datetime(2024, 2, at))
    from plumbline.plans.results import STATS_SCHEMA

    stored = spark.createDataFrame([row("source", "2024-01-20", 5.0), row("target", "2024-01-20", 1.0), row("target", "2024-01-20", 5.0, 2), row("source", "2024-01-21", 7.0), row("source", "2024-01-02", 7.0)], STATS_SCHEMA)
    spec = stats.StatsCompare("t", ["count:*"], [stats.StatsWindow("day", lookback_days=20), stats.StatsWindow("day", lookback_weeks=3), stats.StatsWindow("month")], tolerance_abs=0)
    got = {r["period_key"]: r for r in stats.stats_compare(stored, spec, datetime(2024, 2, 3)).collect()}
    assert set(got) == {"2024-01-20", "2024-01-21"}
    assert got["2024-01-20"]["pass"] and not got["2024-01-21"]["pass"] and got["2024-01-21"]["reason"] == "missing_target"
    assert stats.stats_compare(stored, stats.StatsCompare("t", ["count:*"], [stats.StatsWindow("day")]), datetime(2024, 2, 3)) is None


def test_expectations(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert expectations.expectation(df, "expect_column_values_to_not_be_null", {"column": "x"}).first()["status"] == "FAIL"
    assert expectations.expectation(df, "expect_column_values_to_not_be_null", {"column": "x", "mostly": 0.6}).first()["status"] == "PASS"
    assert expectations.expectation(df, "expect_table_row_count_to_be_between", {"min_value": 4}).first()["status"] == "FAIL"
    assert expectations.expectation(df, "expect_something_else", {}) is None
    status = lambda line, **kw: expectations.check_line(df, line, **kw).first()["status"]
    assert status("row_count > 0") == "PASS" and status("missing_count(x) = 0") == "FAIL" and status("missing_percent(x) < 34") == "PASS"
    assert status("invalid_count(x) = 1", valid_max=2) == "PASS"
    assert expectations.check_line(df, "anomaly score for x < default") is None


def test_alignment(spark, two):
    s, t = two
    found = align(include_map={"key no": {"source": "id", "target": "id"}, "1st": "upper(name)"})
    assert found.names == ["key_no", "c_1st"] and found.source == ["id", "1st"]
    assert align(include=["x"], column_map={"x": {"source": "id", "target": "id + 1"}}).target == ["id + 1"]
    assert align(include_source=["id"], include_target=["name"]).target == ["name"]
    for bad in ({}, {"include": ["q"], "column_map": {"x": "y"}}, {"include_source": ["a"], "include_target": []}):
        with pytest.raises(ValueError):
            align(**bad)
    a, b = align(include=["id", "v"]).apply(s, t)
    assert a.columns == b.columns == ["id", "v"]
    assert sanitize("") == "c_" and split_list("a, f(b, c) AS d, 'x,y'") == ["a", "f(b, c) AS d", "'x,y'"]


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1, "i"), (1, 2, "d"), (2, 1, "i"), (2, 3, None)], "k int, ts int, op string")
    assert [tuple(r) for r in latest_per_key(df, ["k"], ["ts"], "op = 'd'").collect()] == [(2, 3, None)]
    assert latest_per_key(df, ["k"], ["ts"]).count() == 2


@pytest.mark.parametrize(("uri", "engine"), [("a/b.csv", "csv"), ("csv:///a/b.csv", "csv"), ("gs://b/x.csv", "gcs_csv"), ("gcs://b/x.parquet", "gcs_parquet"), ("gcs+parquet://b/dir", "gcs_parquet"), ("postgresql+psycopg2://u:p@h/d", "postgres"), ("mssql+pymssql://u:p@h/d", "mssql"), ("file:///x.parquet", "parquet")])
def test_engines(uri, engine):
    assert engine_of(uri) == engine


def test_connections():
    with pytest.raises(NotImplementedError):
        engine_of("airtable://x")
    with pytest.raises(ValueError):
        engine_of("what://x")
    assert engine_of("gs://x/y.csv", "parquet") == "parquet"
    assert path_of("csv:///a/b.csv") == "/a/b.csv" and path_of("gcs+parquet://b/d") == "gs://b/d"
    assert jdbc_url("mssql://u:p@h/d", "mssql") == ("jdbc:sqlserver://h:1433;databaseName=d", {"user": "u", "password": "p"})


def test_stream_stats(spark, tmp_path):
    from plumbline.operators.stats import Metric
    from plumbline.streaming.stats import stream_stats

    schema = "ts timestamp, v double"
    rows_ = [(datetime(2024, 1, d, 1), float(d)) for d in range(1, 12)]
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = stream_stats(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "week", [Metric("sum", "v", "total")])
    q = out.writeStream.format("memory").queryName("weekly").outputMode("complete").start()
    try:
        q.processAllAvailable()
        got = {r["period_key"]: (r["row_count"], r["total"]) for r in spark.table("weekly").collect()}
    finally:
        q.stop()
    assert got == {"2024-W01": (7, 28.0), "2024-W02": (4, 38.0)}
    with pytest.raises(ValueError):
        stream_stats(spark.range(1), "id", "month", [])


