"""Corpus queries against their SQL, on driver tables and on awkward rows."""

import os

import pytest
from corpus import awkward_rows, words

from resonara.llm import oracle, registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
ITEMS = [(1, " ".join(words(70, 2)[10:40])), (2, "one two"), (3, None), (5, "ONE, two!"), (None, " ".join(words(70, 2)[45:60])), (7, "same " * 12)]


def equal(spark, name, where):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "labels"):
        if os.path.exists(f"{where}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}/{t}.parquet{'' if os.path.isfile(f'{where}/{t}.parquet') else '/*.parquet'}')")
    got = registry.QUERIES[name](spark, where)
    columns = sorted(got.columns)
    sql = con.sql(oracle.SQL[name])
    assert sorted(sql.columns) == columns
    expected = sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({oracle.SQL[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == expected


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, name):
    equal(spark, name, SF)


@pytest.mark.parametrize("name", sorted(set(oracle.SQL) - {"op3_chat_formatting"}))
def test_query_equals_sql_on_awkward_rows(spark, name, tmp_path):
    rows = [(i, t, "en", "src", 0) for i, t in awkward_rows() if i is not None and i not in (3, 12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    equal(spark, name, str(tmp_path))
