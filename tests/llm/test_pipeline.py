"""The corpus pipeline against plain Python versions of its stages, over the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def plain_pipeline(rows, items):
    """rows: (doc_id, text, source), sorted by doc_id."""
    rows = [r for r in rows if brute.quality(r[1])[-1]]
    cut = brute.drop_lines([(d, t) for d, t, _ in rows])
    rows = [(d, t, s) for (d, _, s), (t, gone) in zip(rows, cut) if not gone or brute.words(t)]
    groups = brute.near_duplicates([(d, t) for d, t, _ in rows], corpus_pipeline.NEAR)
    rows = [r for r, (n, c) in zip(rows, groups) if not n or c == r[0]]
    rows = [r for r in rows if not brute.leaks(r[1], items)]
    taken = brute.mix([(d, s, t) for d, t, s in rows])
    return [(d, s, n, total, round(target, 6), k) for (d, _, s), (n, total, target, k) in zip(rows, taken) if k]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
def test_pipeline_equals_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = [(r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in entry.queries()["pipeline"](spark, FOLDER).collect()]
    assert sorted(found) == sorted(plain_pipeline(docs, items))


def test_near_duplicate_stage_links_from_its_own_threshold(spark):
    """Pairs between the stage's threshold and the query's: one stays, and below the stage's both."""
    words = [f"w{i}x" for i in range(200)]
    rows, kept = [], set()
    for k, changed in enumerate((17, 18, 20, 22, 24, 26)):  # a block of changed words in the middle costs four shingles more on both sides
        own = [f"{w}{k}" for w in words]
        other = own[:90] + [f"new{k}{i}" for i in range(changed)] + own[90 + changed:]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        common = 196 - changed - 4
        kept |= {2 * k} | ({2 * k + 1} if 100 * common < corpus_pipeline.NEAR * (392 - common) else set())
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    assert 6 < len(kept) < 12
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == kept
    found = brute.near_duplicates(rows, corpus_pipeline.NEAR)
    assert {d for (d, _), (_, c) in zip(rows, found) if c == d} == kept


def test_stages_take_odd_tables(spark, tmp_path):
    from tests.llm.test_text_operators import SCHEMA, odd_documents

    spark.createDataFrame([("i", "some words of an item that nobody has ever seen before")], "item_id string, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    for rows in (odd_documents(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() <= len(rows)


def test_text_queries_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in names
