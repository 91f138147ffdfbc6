"""The pipeline and the registered queries on small tables."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from corpus import awkward_rows, contamination, near_components, secret_spans, words

from resonara.llm import byte_bpe, quality_rules, registry, secret_scan

ITEMS = [(1, " ".join(words(70, 2)[10:40])), (2, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [*awkward_rows(), *[(100 + k, "The lines of this text end well and so it is good to read. " + " ".join(words(150, k, 4000)) + ".") for k in range(30)]]
    rows += [(200, rows[-1][1] + " more"), (201, rows[-2][1] + " token = " + "0123456789abcdef" * 2)]
    out = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(100 + k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{out}/conversations.parquet")
    spark.createDataFrame([(1, "http://x/", "<article>a</article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{out}/pages.parquet")
    return str(out), rows


def brute(rows, ranks, ratios):
    """The pipeline, stage by stage, in plain Python."""
    measured = [(r, quality_rules.measure((r[1] or "").encode())) for r in rows]
    patterns = np.array([quality_rules.pattern(quality_rules.votes(m)) for _, m in measured])
    model = quality_rules.estimate(patterns, np.ones(len(patterns)))
    good = model.posterior(patterns) >= 0.5
    rows = [r for (r, m), ok in zip(measured, good, strict=True) if ok and not quality_rules.base_failed(m)]
    rows = sorted({r for r, (i, _, c) in zip(rows, near_components(rows), strict=True) if i == c}, key=str)
    rows = [r for r in rows if not contamination(r[1], ITEMS)[1]]
    codec = byte_bpe.codec(*ranks)
    out = []
    for i, t in rows:
        found = [(a, z) for a, _, z, _ in secret_spans(t)]
        found += [(m.start(), m.end()) for m in __import__("re").finditer(secret_scan.TOKEN, t or "") if ratios.score(m[0]) > secret_scan.THRESHOLD]
        text, at = "", 0
        for a, z in sorted(found):
            if a >= at:
                text += t[at:a] + "[SECRET]"
            at = max(at, z)
        (packed,) = codec.encode_all([((text + t[at:]) if found else t or "").encode()])
        out.append((i, len(packed) // 4, hashlib.sha256(packed).hexdigest()))
    return sorted(out, key=str)


def test_pipeline_equals_brute_force(spark, tables, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    where, rows = tables
    models = []
    train = secret_scan.train
    monkeypatch.setattr(secret_scan, "train", lambda x: models.append(train(x)) or models[-1])
    got = corpus_pipeline.run(spark, where)
    found = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in got.collect()), key=str)
    expected = brute(rows, (public_tokenizers.path(registry.VOCABULARY), public_tokenizers.PATTERN), models[0])
    assert found == expected
    ids = {r[0] for r in found}
    assert ids >= {100 + k for k in range(28)} and not ids & {200, 4, 5, 10, 14}


def test_stages_keep_the_columns_of_documents(spark, tables):
    where, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    empty = docs.filter("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).dtypes == docs.dtypes
        assert stage(spark, empty, where).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, where).count() == 0


def test_stages_take_clashing_columns(spark, tables):
    where, rows = tables
    names = ["kept", "ids", "node", "key", "n", "id", "shard", "nth", "row", "secret_spans", "n_words", "component", "kept_id", "runs", "quality"]
    docs = spark.read.parquet(f"{where}/documents.parquet").withColumns({c: F.lit("extra") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
    assert docs.filter(" and ".join(f"`{c}` = 'extra'" for c in names)).count() == docs.count() > 20
    assert corpus_pipeline.STAGES[-1][1](spark, docs, where).count() == docs.count()


def test_only_the_last_stage_stays(spark, tables):
    import glob

    where, _ = tables
    folder = corpus_pipeline.run(spark, where).inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    assert [x.rsplit("/", 1)[1] for x in glob.glob(f"{folder}/*")] == ["4_byte_bpe"]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run_and_cover_their_tables(spark, tables, name):
    pytest.importorskip("public_tokenizers")
    where, rows = tables
    got = registry.QUERIES[name](spark, where)
    n = got.count()
    per_row = {"op1", "op2", "op4", "op6", "op8", "op9"}
    if name.split("_")[0] in per_row:
        assert n == len(rows) and got.columns[0] == "doc_id"
    if name == "op3_chat_formatting":
        assert sorted(r["conv_id"] for r in got.collect()) == [-1, 1]
    if name == "op10_html_extraction":
        assert sorted(map(tuple, got.collect()), key=str) == [(1, "http://x/", "a", 1), (2, None, "", 0)]
