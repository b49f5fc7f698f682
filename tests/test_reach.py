"""Interval labels against plain searches, over chains, rings and random graphs."""

from __future__ import annotations

import random

import pytest

from sluiceway.operators import lineage, reach
from sluiceway.operators.reach import ReachIndex

from .conftest import rows


def plain(edges, start):
    out: set = set()
    todo = [start]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in out:
                out.add(b)
                todo.append(b)
    return out - {start}


def index(spark, edges):
    return ReachIndex.build(spark.createDataFrame(edges, "source string, target string"))


def reached(found, node):
    return {r["uri"] for r in found.reach(node).collect()}


def test_a_chain_of_a_thousand_steps(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(1000)]
    found = index(spark, chain)
    assert reached(found, "n0") == {f"n{i}" for i in range(1, 1001)} and reached(found, "n998") == {"n999", "n1000"} and reached(found, "n1000") == set()
    assert found.links.count() == 0 and reached(found, "stranger") == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_with_rings(spark, seed, monkeypatch):
    monkeypatch.setattr(reach, "SHELF", 7)
    rng = random.Random(seed)
    names = [f"x{i}" for i in range(30)] + ["", "ud", "d"]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(45)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "x1"), ("self", "self"), (None, "a"), ("a", None)]
    found = index(spark, edges)
    known = [(a, b) for a, b in edges if a is not None and b is not None]
    for node in ["a", "x0", "x1", "x7", "self", "", "ud"]:
        assert reached(found, node) == plain(known, node), node


def test_labels_are_nested_or_apart(spark):
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("s", "t")]
    found = index(spark, edges)
    spans = {r["node"]: (r["low"], r["high"]) for r in found.labels.collect()}
    assert set(spans) == set("rabcdst") and len({low for low, _ in spans.values()}) == 7
    for x, (a, b) in spans.items():
        for y, (c, d) in spans.items():
            assert x == y or b < c or d < a or (a < c and d < b) or (c < a and b < d)


def test_both_directions_and_stored_indexes(spark, tmp_path):
    table = lineage.record(spark, "one", ["a", "x"], "b", tenant_id="t").unionByName(lineage.record(spark, "two", ["b"], "c", tenant_id="t")).unionByName(lineage.record(spark, "far", ["c"], "z", tenant_id="u"))
    lineage.reach_index(table, "t").write(f"{tmp_path}/down")
    assert reached(ReachIndex.read(spark, f"{tmp_path}/down"), "a") == {"b", "c"}
    assert reached(lineage.reach_index(table, "t", upwards=True), "c") == {"a", "b", "x"}
    assert reached(lineage.reach_index(table), "x") == {"b", "c", "z"}
    assert rows(lineage.reach_index(table.limit(0)).reach("a")) == []


def test_what_rounds_look_into_is_no_longer_than_the_walk(spark, monkeypatch):
    """Hundreds of links back, each to an interval that holds the next: only the outermost is looked into."""
    monkeypatch.setattr(reach, "SHELF", 8)
    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(600)]
    found = index(spark, chain + [(f"n{i:04}", f"n{i - 297:04}") for i in range(303, 600, 3)])
    kept, settled = [], reach.settled

    def noted(df):
        kept.append(settled(df))
        return kept[-1]

    monkeypatch.setattr(reach, "settled", noted)
    assert reached(found, "n0303") == {f"n{i:04}" for i in range(6, 601)} - {"n0303"}
    assert found.links.count() == 99 and max(sum(r["high"] - r["low"] + 1 for r in df.collect()) for df in kept) <= 2 * 601


@pytest.mark.parametrize("seed", [3, 4])
def test_rings_and_chains_over_many_blocks(spark, seed, monkeypatch):
    monkeypatch.setattr(reach, "SHELF", 5)
    monkeypatch.setattr(reach, "BLOCK", 4)
    rng = random.Random(seed)
    names = [f"y{i:02}" for i in range(40)]
    ring, chain = rng.sample(names, 12), rng.sample(names, 25)
    edges = [*zip(ring, ring[1:] + ring[:1]), *zip(chain, chain[1:]), *((rng.choice(names), rng.choice(names)) for _ in range(12)), ("z1", "z2"), ("z2", "z1"), ("z2", "z3")]  # noqa: B905, RUF005
    found = index(spark, edges)
    for node in [ring[0], ring[5], chain[0], chain[12], "z1", "z3"]:
        assert reached(found, node) == plain(edges, node), node
    spans = [(r["low"], r["high"]) for r in found.labels.collect()]
    assert len({x for span in spans for x in span}) == 2 * len(spans)
    assert all(b < c or d < a or a < c < d < b or c < a < b < d for a, b in spans for c, d in spans if a != c)


def test_a_chain_is_written_a_few_times_whatever_its_length(spark, monkeypatch):
    """Rows written while an index is built: not a round of all of them for each doubling."""
    monkeypatch.setattr(reach, "BLOCK", 64, raising=False)
    written, settled = [], reach.settled

    def noted(df):
        written.append(settled(df))
        return written[-1]

    monkeypatch.setattr(reach, "settled", noted)
    found = index(spark, [(f"n{i:04}", f"n{i + 1:04}") for i in range(2000)])
    assert reached(found, "n1995") == {f"n{i:04}" for i in range(1996, 2001)}
    assert sum(df.count() for df in written) <= 14 * 2001
