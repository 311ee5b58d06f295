"""The pipeline against a brute-force version of its stages."""

import re

import numpy as np
import pytest

import corpus_pipeline
from gossamer.llm import quality, secrets

from .conftest import CASES
from .test_outputs import check_packing
from .test_texts import components_by_hand, contamination_by_hand


def redacted_by_hand(text):
    """Every character inside a span is marked, and each stretch of overlapping spans becomes one mark."""
    if not text:
        return text
    owner = [None] * len(text)
    reach, group = -1, 0
    for a, _, b in sorted(secrets.spans_of(text)):
        group += a >= reach
        reach = max(reach, b)
        for k in range(a, b):
            owner[k] = group
    return "".join("[secret]" if g is not None and (k == 0 or owner[k - 1] != g) else "" if g is not None else c for k, (c, g) in enumerate(zip(text, owner)))


def by_hand(rows, items, model):
    """rows: (doc_id, text).  The rows that packing gets."""
    scores = model.score(np.array([quality.features_of((t or "").encode()) for _, t in rows]))
    rows = [r for r, s in zip(rows, scores) if s >= 0.3]
    kept, seen = [], set()
    for row, (_, _, component) in sorted(zip(rows, components_by_hand(rows)), key=lambda x: x[0][0]):
        if component not in seen:
            seen.add(component)
            kept.append(row)
    clean = [r for r, c in zip(kept, contamination_by_hand(kept, items)) if not c[5]]
    return [(d, redacted_by_hand(t)) for d, t in clean]


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    return docs, items


def test_pipeline(spark, sf_dir, tables):
    docs, items = tables
    model = quality.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    expected = by_hand(docs, items, model)
    assert 0 < len(expected) < len(docs)
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), expected)


def test_stages_return_the_columns_of_documents(spark, sf_dir, cases, nothing):
    assert len(corpus_pipeline.STAGES) == 5
    for docs in (cases, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "packing":
                assert out.columns == corpus_pipeline.COLUMNS
            assert out.count() <= (len(CASES) + 20 if docs is cases else 0) or name == "packing"


def test_clean_documents_stay(spark, sf_dir):
    """Documents labelled good, without copies, passages or secrets pass every filter unchanged."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_stage(spark, docs, sf_dir).collect()}
    assert len(kept.keys() & rows.keys()) >= 0.98 * len(rows)
    plain = {d for d, t in rows.items() if not re.search("[0-9]", t)}
    after = {r.doc_id: r.text for r in corpus_pipeline.secrets_stage(spark, docs, sf_dir).collect()}
    assert all(after[d] == rows[d] for d in plain)
