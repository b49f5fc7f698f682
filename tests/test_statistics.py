"""Exact statistics and samples that no single task can hold, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.functions.columns import exact_quantiles, modes, order_statistics
from sluiceway.operators.clean import impute, label_encode
from sluiceway.operators.sample import importance_sample, random_sample, stratified_sample, with_row_id


def interpolated(values, point):
    values = sorted(values)
    at = point * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.fixture(scope="module")
def numbers(spark):
    draw = random.Random(3)
    rows = []
    for i in range(3000):
        hot = 7.0 if draw.random() < 0.34 else draw.gauss(0, 10)
        rows.append((i, hot, draw.randrange(5), None if draw.random() < 0.5 else i // 3, draw.choice("aabbbbcd"), None))
    return spark.createDataFrame(rows, "id int, hot double, few int, holes int, word string, nothing double").repartition(7), rows


def test_quantiles_by_narrowing(numbers):
    df, rows = numbers
    points = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    names = ["id", "hot", "few", "holes", "nothing"]
    whole, narrowed = exact_quantiles(df, names, points), exact_quantiles(df, names, points, held=1)
    for place, name in enumerate(names[:4]):
        given = [r[place] for r in rows if r[place] is not None]
        for found in (whole, narrowed):
            assert found[name] == pytest.approx([interpolated(given, p) for p in points])
    assert whole["nothing"] == narrowed["nothing"] == [None] * len(points)


def test_order_statistics_of_a_hot_value(numbers):
    df, rows = numbers
    values = sorted(r[1] for r in rows)
    first, last = values.index(7.0), len(values) - 1 - values[::-1].index(7.0)
    ranks = [0, first - 1, first, last, last + 1, len(values) - 1]
    found = order_statistics(df, {"hot": ranks}, {"hot": len(values)}, held=2)
    assert [found["hot", r] for r in ranks] == [values[r] for r in ranks]


def test_modes(numbers, spark):
    df, rows = numbers
    got = modes(df, ["few", "word", "nothing"], ["a", "b", "c"]).first()
    counts = {w: sum(r[2] == w for r in rows) for w in range(5)}
    assert got["a"] == min(counts, key=lambda w: (-counts[w], w)) and got["b"] == "b" and got["c"] is None
    assert modes(df.limit(0), ["few"], ["a"]).first()["a"] is None
    assert impute(df.limit(0), "mode").count() == 0


def test_labels_over_several_ranges(spark):
    words = [f"w{i * 7919 % 5003}" for i in range(2500)] + [None, "w1", ""]
    df = spark.createDataFrame([(w, w) for w in words], "word string, same string").repartition(5)
    places = {w: i for i, w in enumerate(sorted({w if w is not None else "None" for w in words}))}
    for r in label_encode(df, "word").collect():
        assert r["word"] == places[r["same"] if r["same"] is not None else "None"]


def test_row_ids_with_nulls_in_the_order(spark):
    rows = [(None if i % 5 == 0 else i % 11, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    got = [(r["a"], r["b"]) for r in sorted(with_row_id(df, ["a", "b"]).collect(), key=lambda r: r["_row_id"])]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_samples_are_the_first_by_hash(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 12}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, s string").repartition(6)
    ordered = sorted(rows, key=lambda r: hashlib.md5(f"42|{r[0]}".encode()).hexdigest())
    for n in (1, 250, 1999, 2000, 2001):
        assert sorted(map(tuple, random_sample(df, n, ["id"]).collect())) == sorted(ordered[:n])
    assert random_sample(df.limit(0), 5, ["id"]).count() == 0
    expected = []
    for s in {r[1] for r in rows}:
        mine = [r for r in ordered if r[1] == s]
        expected += mine[: max(1, round(500 * len(mine) / len(rows)))]
    assert sorted(map(tuple, stratified_sample(df, 500, "s", ["id"]).collect())) == sorted(expected)


def test_repeated_draw_keys_still_give_n_rows(spark):
    df = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    assert random_sample(df, 17, ["k"]).count() == 17


def test_importance_draws_ties_to_the_row(spark):
    df = spark.range(400).select(F.lit("same").alias("k"), F.lit(1.0).alias("w"), F.col("id").alias("x"))
    assert importance_sample(df, 33, "w", ["k"]).count() == 33
