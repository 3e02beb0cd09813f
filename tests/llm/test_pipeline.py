import duckdb
import pytest

import corpus_pipeline
from kelvane.llm import queries
from kelvane.llm.common import Scratch

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before, scratch = docs.columns, docs.count(), Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, SMALL))
        if name != "packing":
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            assert 0.6 * before < docs.count() <= before
    per = docs.groupBy("sequence_id").sum("length").collect()
    assert per and max(r[1] for r in per) <= 4096


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.queries()[name](spark, SMALL).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    tidy = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))
