"""Engine queries against their SQL over tables of many charts: 150,000 orders, 20,000 parts and 2,000 vectors."""

import os

import pytest

from pyspark.sql import functions as F

from resonara.plans import oracle, pipeline, registry, tables

duckdb = pytest.importorskip("duckdb")
LARGE = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")


@pytest.mark.parametrize("name", ["line_classify", "wav_def_scan", "file_list", "token_rewrite", "change_definition", "undefined_refs_anti", "matching_pairs", "greedy_clusters", "component_clusters", "block_keys", "band_join_pairs", "reduce_pipeline", "pearson_pairs"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{LARGE}/{t}.parquet')")
    got = registry.QUERIES[name](spark, LARGE)
    columns = sorted(got.columns)
    expected = sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({oracle.SQL[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == expected


def test_charts_hold_every_order_and_part_once(spark):
    lines = tables.chart(spark, LARGE)
    parts, orders = tables.table(spark, LARGE, "part").count(), tables.table(spark, LARGE, "lineitem").select("l_orderkey").distinct().count()
    charts = lines.select("path").distinct().count()
    assert charts == 10
    assert lines.count() == lines.select("path", "line_no").distinct().count() == charts + parts + orders


def test_sounds_hold_every_vector_and_copy(spark):
    files = tables.sounds(spark, LARGE)
    n = 2 * tables.table(spark, LARGE, "embeddings").count()
    assert files.count() == files.select("path", "num_int").distinct().count() == n == 4000
    assert files.agg(F.max("num_int")).first()[0] <= 3843
    assert registry.QUERIES["greedy_clusters"](spark, LARGE).count() == n


def test_each_chart_is_reduced_as_alone(spark):
    files = tables.sounds(spark, LARGE).cache()
    got = registry.QUERIES["reduce_pipeline"](spark, LARGE).collect()
    assert {r["path"] for r in got} == {f"song{k}.bms" for k in range(4)}
    for path in ("song0.bms", "song3.bms"):
        own = files.filter(files.path == path)
        lines = own.select("path", F.col("idx").alias("line_no"), F.concat(F.lit("#WAV"), "num", F.lit(" "), "name").alias("line"))
        alone = pipeline.reduce_chart(lines, own, 0.3).lines
        assert sorted(r["line"] for r in alone.collect()) == sorted(r["line"] for r in got if r["path"] == path and r["line"].startswith("#WAV"))
