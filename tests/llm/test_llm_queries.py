"""Registered corpus queries against their SQL twins, and the pipeline stage by stage."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from suite.check import compare, connect
from treegauge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, connect(SF), ORACLES[name]) in ("", "EMPTY")
    else:
        assert df.count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.dtypes == before.dtypes
    assert corpus_pipeline.run(spark, SF).count() == docs.count() > 0


def test_pipeline_stages_on_awkward_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "en", "a", 1), (2, text, "en", "a", 1), (1, text, "en", "a", 1), (3, None, None, None, None), (None, "x y z", "en", "a", 1), (4, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.where("text is null or text = ''").count() == 0
    assert corpus_pipeline.drop_repeated_lines(spark, docs, SF).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_go_under_null_and_repeated_ids(spark):
    def text(kind, end=""):
        return " ".join(f"{kind}{k}" for k in range(60)) + end

    rows = [(None, text("a"), "s"), (None, text("a"), "t"), (None, text("a", " more"), "s"),  # copies among null ids only
            (1, text("b"), "s"), (None, text("b", " more"), "s"),  # a null id beside an id
            (2, text("c"), "s"), (2, text("c", " more"), "s"), (2, text("d"), "s"), (3, text("d", " more"), "s"),  # unlike texts under one id
            (4, text("e"), "s"), (4, text("e"), "t"), (None, None, "s"), (5, "", "s")]
    kept = corpus_pipeline.drop_near_copies(spark, _rows(spark, rows), SF).collect()
    kinds = sorted((r.text or "")[:1] for r in kept)
    assert kinds == ["", "", "a", "b", "c", "d", "e"]
    assert {(r.text[0], r.doc_id) for r in kept if r.text} == {("a", None), ("b", 1), ("c", 2), ("d", 2), ("e", 4)}


def test_mix_writes_each_row_as_often_as_it_is_taken(spark):
    rows = [(None if k % 3 else k % 4, " ".join(f"w{k}x{j}" for j in range(5 + k % 7)), f"s{k % 3}") for k in range(120)]
    rows += [(None, "same words here", "s0")] * 9 + [(None, "", "s1"), (None, None, "s1")]
    docs = _rows(spark, rows)
    written = Counter((r.doc_id, r.text, r.source) for r in corpus_pipeline.mix(spark, docs, SF).collect())
    held = Counter(rows)
    assert all(row in held and n <= 2 * held[row] for row, n in written.items()) and not any(not row[1] for row in written)
    words = sum(n * len(row[1].split()) for row, n in written.items())
    assert words == sum(r.taken for r in corpus_pipeline.mixing.mix_sources(docs).collect())
    assert words <= 1.5 * sum(len((t or "").split()) for _, t, _ in rows)
