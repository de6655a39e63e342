"""The pipeline's stages and the catalogue's contracts on the smallest tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from plumbline.llm import catalogue, common

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not Path(DATA).is_dir():
        pytest.skip("no sample tables")
    docs = common.read(spark, DATA, "documents")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA))
        out.append((name, docs))
    return out


def test_stages(stages):
    columns = stages[0][1].columns
    assert [n for n, _ in stages[1:]] == ["language_id", "jaccard_join", "pii", "mixing", "packing"]
    for _, df in stages[1:-1]:
        assert df.columns == columns and df.schema.simpleString() == stages[0][1].schema.simpleString()
    sizes = {n: df.count() for n, df in stages}
    assert sizes["documents"] >= sizes["language_id"] >= sizes["jaccard_join"] == sizes["pii"] > 0
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in stages}
    assert ids["language_id"] == ids["documents"] and ids["packing"] == ids["mixing"] <= ids["pii"]
    pieces = stages[-1][1]
    assert pieces.selectExpr("sum(length)").first()[0] == 1024 * (pieces.select("sequence_id").distinct().count() - 1) + pieces.groupBy("sequence_id").sum("length").selectExpr("min(`sum(length)`)").first()[0]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).is_dir():
        pytest.skip("no sample tables")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    rel = con.sql(catalogue.ORACLE_SQL[name])
    names = sorted(rel.columns)
    df = catalogue.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == names
    want = sorted(str([dict(zip(rel.columns, r, strict=True))[c] for c in names]) for r in rel.fetchall())
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == want
