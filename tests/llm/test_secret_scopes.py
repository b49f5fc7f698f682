"""Secrets linked over whole scopes, with their full spans."""

from __future__ import annotations

from sluiceway.llm import secrets

KEY, SECRET = "AKIA" + "Z" * 16, "q1" * 20


def linked(text, reach=None):
    return [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.link(text, secrets.base_spans(text), reach)]


def test_far_parts_of_a_scope():
    url = "https://example.com/" + "p" * 50
    text = f"{KEY} {'x ' * 450}{SECRET} {'x ' * 450}{url}\n\n{SECRET[::-1]} other.example.com"
    assert linked(text) == [("linked_secret", SECRET), ("linked_endpoint", url)]
    assert linked(f"{SECRET}{' ' * 900}{KEY}") == [("linked_secret", SECRET)]


def test_a_reach_cuts_no_span():
    assert linked(f"{KEY} {'.' * 379}{SECRET}", 400) == [("linked_secret", SECRET)]
    url = "https://example.com/" + "p" * 50
    assert linked(f"{KEY} {SECRET} {' ' * 340}{url}", 400) == [("linked_secret", SECRET), ("linked_endpoint", url)]
    assert linked(f"{KEY} {'.' * 359}{'q1' * 50}", 400) == []


def test_rows(spark):
    far = KEY + " " * 900 + SECRET
    (row,) = secrets.find_secrets(spark.createDataFrame([(1, far)], "doc_id long, text string")).collect()
    assert [s["kind"] for s in row["spans"]] == ["access", "linked_secret"]
