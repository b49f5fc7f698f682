"""The corpus pipeline, stage by stage, against plain Python."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline
from sluiceway.llm import toxicity
from sluiceway.llm.common import materialise

from ..conftest import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, str(DATA)), f"test-{name}")
        assert out.columns == docs.columns
        seen[name] = (docs.collect(), out.collect())
        docs = out
    before, after = seen["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if model.score(r["text"] or "") < 0.5}
    before, after = seen["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(first.values())
    before, after = seen["jaccard_join"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = seen["mixture"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    text = {r["doc_id"]: r["text"] for r in before}
    total = sum(words(t) for t in text.values())
    assert abs(sum(words(r["text"]) for r in after) - 1.5 * total) <= 20
    assert all(text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in after)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect()
    assert sorted(r["decoded_sha256"] for r in last) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in after)


def test_run(spark):
    assert corpus_pipeline.run(spark, str(DATA)).count() > 0
