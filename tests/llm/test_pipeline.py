"""Stages of corpus_pipeline against plain versions of their rules."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from llm_fixtures import documents, edge, empty  # noqa: E402, F401

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, documents, tmp_path):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if "doc_id" in docs.columns else {}
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == COLUMNS
        if name == "near_duplicates":
            want = {i for i, (_, c) in brute.components(before.items()).items() if c == i}
            assert {r.doc_id for r in rows} == want and len(rows) == len(want)
        if name == "repeated_passages":
            want = {i: t if n == 0 else k for i, (w, n, k), t in ((i, v, before[i]) for i, v in brute.without_repeats(before.items()).items()) if not (n and not k)}
            assert {r.doc_id: r.text for r in rows} == want
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "mixture":
            copies = Counter(r.doc_id for r in rows)
            assert set(copies) <= set(before) and max(copies.values()) <= 2 and all(r.text == before[r.doc_id] for r in rows)
            kept = copies
        if name == "packing":
            assert Counter(r.doc_id for r in rows if r.start == 0) == kept
    assert len(rows) > 0


def test_odd_rows_and_extra_columns(spark, edge, tmp_path):
    docs = edge
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == edge.columns
    assert docs.where("doc_id is null").count() == 1  # the row without id is packed


def test_empty_table(spark, empty, tmp_path):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_run_is_registered(spark):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is corpus_pipeline.run
