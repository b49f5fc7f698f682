"""File-pruned merges against plain dictionaries, and what they leave alone."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sluiceway.plans import keyed_files
from sluiceway.plans.keyed_files import KeyedFiles

from .conftest import rows


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedFiles(spark, str(tmp_path / "t"), rows_per_file=100)
    t.create(spark.range(2000).select((F.col("id") * 3).alias("k"), (F.col("id") % 7).alias("v"), F.lit("a").alias("s")), ["k"])
    return t


def paths(t, version=None):
    return {r["file"] for r in t.files(version).collect()}


def test_only_touched_files_are_written_anew(spark, table):
    before = paths(table)
    assert len(before) >= 18 and table.state()["rows"] == 2000
    delta = spark.createDataFrame([(300, 100, None), (303, None, "b"), (306, 1, "c"), (301, 5, "new")], "k long, v long, s string")
    done = table.merge(delta, F.col("k") == 306)
    assert (done.inserted_rows, done.updated_rows, done.deleted_rows) == (1, 2, 1)
    after = paths(table)
    assert done.files_rewritten == len(before - after) <= 2 and done.files_kept == len(before & after) >= 16 and done.files_written == len(after - before)
    got = {r["k"]: (r["v"], r["s"]) for r in table.read().collect()}
    want = {i * 3: (i % 7, "a") for i in range(2000)}
    want |= {300: (100, "a"), 303: (101 % 7, "b"), 301: (5, "new")}
    del want[306]
    assert got == want and table.state()["rows"] == 2000
    # The first version is still there, whole.
    assert paths(table, 0) == before and table.read(0).count() == 2000 and table.read(0).filter("k = 306").count() == 1
    with pytest.raises(KeyError):
        table.read(9)


def test_keys_within_ranges_that_no_file_holds(spark, table):
    """Absent keys inside a file's range: the bitmap leaves most files alone."""
    absent = spark.range(0, 2000, 100).select((F.col("id") * 3 + 1).alias("k"))
    hit = table.touched(absent).count()
    assert hit <= 3
    everything = spark.range(0, 2000, 100).select((F.col("id") * 3).alias("k"))
    assert table.touched(everything).count() >= 18
    outside = spark.createDataFrame([(-5,), (10**9,)], "k long")
    done = table.merge(outside.withColumn("v", F.lit(1).cast("long")))
    assert (done.inserted_rows, done.files_rewritten) == (2, 0) and table.read().filter("s IS NULL").count() == 2


def test_no_touched_file_is_missed(spark, tmp_path, monkeypatch):
    """Random merges of keys of two columns with nulls, over overlapping files, against a dictionary."""
    monkeypatch.setattr(keyed_files, "CHAIN", 3)
    rng = random.Random(4)
    t = KeyedFiles(spark, str(tmp_path / "t"), rows_per_file=20)
    key = lambda: (rng.choice(["x", "y", None]), rng.randint(0, 60))
    schema = "a string, b int, v int, w string"
    want = {key(): (rng.randint(0, 9), "old") for _ in range(90)}
    t.create(spark.createDataFrame([(*k, *v) for k, v in want.items()], schema), ["a", "b"])
    for round_no in range(5):
        delta = {key(): (rng.choice([None, rng.randint(0, 9)]), None if rng.random() < 0.3 else f"r{round_no}", rng.random() < 0.3) for _ in range(rng.choice([1, 12]))}
        inserted = sum(k not in want and not v[2] for k, v in delta.items())
        dropped = sum(k in want and v[2] for k, v in delta.items())
        done = t.merge(spark.createDataFrame([(*k, v[0], v[1], v[2]) for k, v in delta.items()], schema + ", gone boolean").drop("gone") if not any(v[2] for v in delta.values()) else spark.createDataFrame([(*k, v[0], "DEL" if v[2] else v[1]) for k, v in delta.items()], schema), F.col("w") == "DEL")
        assert (done.inserted_rows, done.deleted_rows) == (inserted, dropped)
        for k, (v, w, gone) in delta.items():
            if gone:
                want.pop(k, None)
            else:
                old = want.get(k, (None, None))
                want[k] = (old[0] if v is None else v, old[1] if w is None else w)
        assert {(r["a"], r["b"]): (r["v"], r["w"]) for r in t.read().collect()} == want and t.state()["rows"] == len(want)
    assert t.read(0).count() == len({(r["a"], r["b"]) for r in t.read(0).collect()})


def test_a_broken_merge_changes_nothing(spark, table, monkeypatch):
    delta = spark.createDataFrame([(300, 100, "z")], "k long, v long, s string")
    good = table.records.append
    monkeypatch.setattr(table.records, "append", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.merge(delta)
    monkeypatch.setattr(table.records, "append", good)
    assert table.state()["version"] == 0 and table.read().filter("s = 'z'").count() == 0
    assert table.merge(delta).version == 1 and rows(table.read().filter("s = 'z'")) == [{"k": 300, "v": 100, "s": "z"}]


def test_columns_that_come_later_and_empty_tables(spark, tmp_path):
    t = KeyedFiles(spark, str(tmp_path / "t"), rows_per_file=10)
    t.create(spark.createDataFrame([], "k int, v int"), ["k"])
    assert t.read().count() == 0 and t.state()["rows"] == 0
    assert t.merge(spark.createDataFrame([], "k int, v int")).version == 0
    t.merge(spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"))
    t.merge(spark.createDataFrame([(2, 5, "n"), (3, 3, "m")], "k int, v int, extra string"))
    assert {tuple(r) for r in t.read().collect()} == {(1, 1, None), (2, 5, None), (3, 3, "m")}
    t.merge(spark.createDataFrame([(1,), (2,), (3,)], "k int"), F.lit(True))
    assert t.read().count() == 0 and t.read(2).count() == 3
