"""Every engine query against its DuckDB SQL, over the smallest tables."""

import os

import pytest

from resonara.plans import oracle, registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracle.SQL)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, sql, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(sql.sql(oracle.SQL[name]).columns) == columns
    found = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    expected = sorted(map(repr, sql.sql(f"SELECT {', '.join(columns)} FROM ({oracle.SQL[name]})").fetchall()))
    assert found == expected


@pytest.mark.parametrize("name", ["greedy_clusters", "component_clusters"])
def test_clusters_are_sound(spark, name):
    rows = {(r["path"], r["num_int"]): r for r in registry.QUERIES[name](spark, SF).collect()}
    for (path, n), r in rows.items():
        assert (path, r["replace_to"]) in rows and rows[path, r["root"]]["root"] == r["root"]
        assert (r["replace_to"] == n) == (r["root"] == n)


def test_sweep_counts_fall_with_the_threshold(spark):
    files = dict(map(tuple, registry.tables.sounds(spark, SF).groupBy("path").count().collect()))
    unique = dict(map(tuple, registry.QUERIES["greedy_clusters"](spark, SF).filter("root = num_int").groupBy("path").count().collect()))
    rows = registry.QUERIES["sweep_counts"](spark, SF).collect()
    for path, n in files.items():
        points = {r["threshold"]: r["file_count"] for r in rows if r["path"] == path}
        assert len(points) == 101 and points[1.0] <= n and points[0.0] >= 1
        assert points[0.3] == unique[path]


def test_reduced_charts_refer_to_their_definitions(spark):
    rows = registry.QUERIES["reduce_pipeline"](spark, SF).collect()
    for path in {r["path"] for r in rows}:
        lines = [r["line"] for r in rows if r["path"] == path]
        defined = [x[4:6] for x in lines if x.startswith("#WAV")]
        assert len(set(defined)) == len(defined) > 0
        used = {x[k : k + 2] for x in lines if not x.startswith("#WAV") for k in range(7, len(x), 2)}
        assert used <= set(defined)
