"""Versions by trees of chunk hashes: names, sharing, differences, restoring."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sluiceway.plans.version_store import FAN, VersionStore

from .conftest import rows


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = VersionStore(spark, str(tmp_path_factory.mktemp("store")), rows_per_chunk=12)
    table = spark.range(3000).select("id", (F.col("id") % 9).alias("v"), F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("row"), F.timestamp_seconds(F.col("id")).alias("_chunk"))
    return s, table, s.commit(table, ["id"], {"by": "test"})


def test_equal_rows_are_one_version(spark, store):
    s, table, version = store
    assert s.get(version)["chunks"] == 256 and s.nodes(version).count() == 256 // FAN
    assert s.commit(table.orderBy(F.rand(1)).repartition(7).select("v", "row", "_chunk", "id"), ["id"]) == version
    assert s.get(version)["stored_rows"] == 0 and s.list().count() == 2
    assert rows(s.restore(version), "id") == rows(table, "id")


def test_changes_share_all_other_chunks(spark, store):
    s, table, version = store
    changed = table.filter("id <> 17").withColumn("v", F.when(F.col("id") == 40, -1).otherwise(F.col("v"))).unionByName(table.filter("id = 5").withColumn("id", F.lit(90_000).cast("long")))
    other = s.commit(changed, ["id"])
    assert other != version and 0 < s.get(other)["stored_rows"] < 100
    apart = s.unequal(version, other)
    assert 1 <= apart.count() <= 3
    got = {(r["change"], (r["old"] or r["new"])["id"]): r for r in s.diff(version, other).collect()}
    assert set(got) == {("removed", 17), ("changed", 40), ("added", 90_000)}
    assert got["changed", 40]["old"]["v"] == 4 and got["changed", 40]["new"]["v"] == -1
    assert s.diff(other, other).count() == 0
    assert rows(s.restore(version), "id") == rows(table, "id") and rows(s.restore(other), "id") == rows(changed, "id")
    # Rows of equal chunks aren't read: without their files the difference is the same.
    wanted = {(r["old_batch"], r["chunk"]) for r in apart.collect()}
    moved = [f"{d}" for d, _, _ in os.walk(f"{s.root}/objects") if "/_chunk=" in d and (d.split("/")[-2], int(d.rsplit("=", 1)[1])) not in wanted]
    first = next(d for d in moved if d.split("/")[-2] == next(iter(wanted))[0])
    os.rename(first, first + "-away")
    try:
        assert s.diff(version, other).count() == 3
    finally:
        os.rename(first + "-away", first)


def test_new_columns_nulls_and_empty_tables(spark, tmp_path):
    s = VersionStore(spark, str(tmp_path))
    empty = s.commit(spark.createDataFrame([], "a int, b string"), ["a"])
    some = s.commit(spark.createDataFrame([(1, "x"), (None, "n"), (2, None)], "a int, b string"), ["a", "unknown"])
    more = s.commit(spark.createDataFrame([(1, "x", 5), (None, "n", None), (2, None, None)], "a int, b string, c int"), ["a"])
    assert len({empty, some, more}) == 3 and s.restore(empty).count() == 0
    assert {(r["change"], r["new"]["a"]) for r in s.diff(empty, some).collect()} == {("added", 1), ("added", None), ("added", 2)}
    assert [(r["change"], r["new"]["a"], r["new"]["c"]) for r in s.diff(some, more).collect()] == [("changed", 1, 5)]
    with pytest.raises(KeyError):
        s.restore("nothing")
    with pytest.raises(KeyError):
        VersionStore(spark, str(tmp_path), "other").get(some)
