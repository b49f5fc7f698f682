"""The corpus pipeline where ids are null or repeat."""

from __future__ import annotations

import re

import corpus_pipeline

from ..conftest import DATA
from .test_text_ops import EDGE, SCHEMA

NEAR = [f"w{i}" for i in range(60)]
A, B, C = " ".join(NEAR), " ".join(NEAR[:-1] + ["other"]), "a text of its own that nothing else is like"
BLANKS = r"[\x20\x09-\x0D]+"


def texts(df):
    return sorted(r["text"] or "" for r in df.collect())


def test_exact_copies_go_by_row(spark):
    stage = lambda rows: corpus_pipeline.drop_exact(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(DATA))
    assert texts(stage([(None, "alone"), (None, "x"), (1, "x")])) == ["alone", "x"]
    assert texts(stage([(1, "A"), (5, "A"), (5, "B")])) == ["A", "B"]
    assert texts(stage([(1, "A"), (1, "A"), (2, "A")])) == ["A"]
    assert texts(stage([(None, "n"), (None, "n")])) == ["n"]
    (kept,) = stage([(None, "x"), (7, "x"), (3, "x"), (3, "y z"), (3, "y  z")]).filter("text = 'x'").collect()
    assert kept["doc_id"] == 3


def test_near_copies_go_by_row(spark):
    stage = lambda rows: corpus_pipeline.drop_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(DATA))
    assert texts(stage([(1, A), (5, B), (5, C)])) == sorted([A, C])
    assert texts(stage([(None, A), (None, B), (None, C)])) in (sorted([A, C]), sorted([B, C]))
    assert [r["doc_id"] for r in stage([(None, A), (4, B), (4, B)]).collect()] == [4]


def test_stages_of_odd_table(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    clean = corpus_pipeline.drop_toxic(spark, docs, str(DATA))
    once = corpus_pipeline.drop_exact(spark, clean, str(DATA))
    same = lambda t: re.sub(BLANKS, " ", t)
    assert once.columns == docs.columns
    assert sorted(same(t) for t in texts(once)) == sorted({same(t) for t in texts(clean)})
    near = corpus_pipeline.drop_near(spark, once, str(DATA))
    assert texts(near) == texts(once)
    mixed = corpus_pipeline.mix(spark, near, str(DATA))
    words = lambda df: sum(len(t.split()) for t in texts(df))
    assert mixed.columns == docs.columns and abs(words(mixed) - 1.5 * words(near)) <= 3
    assert len(corpus_pipeline.tokenise(spark, mixed, str(DATA)).collect()) == mixed.count()


def test_mix_takes_each_row_for_itself(spark):
    rows = [(None if i % 2 else 1, " ".join([f"t{i}"] * (i + 1)), "s", 0) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mixed = corpus_pipeline.mix(spark, docs, str(DATA))
    assert abs(sum(len(t.split()) for t in texts(mixed)) - 54) <= 1


def test_columns_of_any_name_go_through(spark):
    """Columns named like the stages' own come out as they went in, with or without n_chars."""
    import corpus_pipeline

    rows = [(i, f"text number {i // 2} of a few words that two rows share", "en", "a", i, i + 1, i + 2, i + 3) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, gone long, row_number long, plan long, taken long")
    for stage in (corpus_pipeline.drop_exact, corpus_pipeline.drop_near, corpus_pipeline.mix):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert {tuple(r)[4:] for r in out.collect()} <= {r[4:] for r in rows}
