"""The pipeline at the smallest size, and the queries with SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from skaldic.llm import queries
from skaldic.llm.common import materialize, read

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, SF), "test")
        if k < 4:
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} and docs.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found, wanted = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(str).itertuples(index=False, name=None)))
    assert rows(found) == rows(wanted)
