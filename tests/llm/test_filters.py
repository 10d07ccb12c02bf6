"""Filtering stages on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

from drawlog.llm import decontaminate, quality, secret_scan


def keys(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "", r.n_chars or 0) for r in df.collect())


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "One"), (2, None), (None, " ")], "item_id long, text string")


def test_quality_without_usable_labels(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 0), (6, None)], "doc_id long, quality int")
    out = quality.good(edge_docs, labels)
    assert out.columns == edge_docs.columns and keys(out) == keys(edge_docs)
    assert quality.good(no_docs, labels).collect() == []


def test_redaction_leaves_clean_rows(edge_docs, no_docs):
    out = secret_scan.redact(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    clean = "doc_id IN (1, 2, 3, 4, 5) OR doc_id IS NULL"
    assert keys(out.where(clean)) == keys(edge_docs.where(clean))
    assert secret_scan.redact(no_docs).collect() == []


def test_decontamination_drops_whole_texts(spark, edge_docs, no_docs, items):
    out = decontaminate.clean(edge_docs, items)
    assert out.columns == edge_docs.columns
    assert keys(out) == keys(edge_docs.where("doc_id IS NULL OR doc_id NOT IN (4, 5)"))
    assert keys(decontaminate.clean(edge_docs, items.limit(0))) == keys(edge_docs)
    assert decontaminate.clean(no_docs, items).collect() == []
