"""Every query of the catalogue against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os
from pathlib import Path

import pytest

from plumbline.queries import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.is_dir():
        pytest.skip("no sample tables")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, bool) or isinstance(v, float) and math.isnan(v):
        return v if isinstance(v, bool) else None
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    return str(v)[:19] if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, str(DATA))
    rel = db.sql(ORACLE_SQL[name])
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    want = sorted((tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in names) for r in rel.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str) == want


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if DATA.is_dir():
        assert e.entry(spark).count() == 1


def test_whole_id_range_is_sampled(spark, tmp_path):
    """Ranges beyond the first 20 chunks, and those of extra rows far beyond, are found."""
    from plumbline.queries import QUERIES

    n = 30_000
    spark.range(n).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    rows = QUERIES["sample_chunk"](spark, str(tmp_path)).collect()
    missing, extra = len(range(0, n, 97)), len(range(0, n, 101))
    assert sum(r["diff"] for r in rows if r["range_start"] < n) == missing
    assert sum(r["diff"] for r in rows if r["range_start"] >= 1_000_000) == -extra
    assert any(20_000 <= r["range_start"] < n for r in rows)
    assert QUERIES["sample_chunk_top"](spark, str(tmp_path)).count() == 5
