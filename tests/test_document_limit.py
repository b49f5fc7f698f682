"""The limit of document sources."""

from __future__ import annotations

from sluiceway import queries
from sluiceway.sources import readers


def test_limit_only_where_asked(spark, monkeypatch):
    rows = spark.range(10)
    assert [readers.document_find(rows, {"limit": n}).count() for n in (0, 3)] == [10, 3]
    asked = []
    monkeypatch.setattr(readers, "document_find", lambda df, config: asked.append(config))
    monkeypatch.setattr(queries, "table", lambda *_: rows)
    queries.QUERIES["src_document_find"](spark, "")
    assert not asked[0].get("limit")
