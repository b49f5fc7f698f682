"""Order and distribution expectations against plain Python."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import gate


def run(df, *checks):
    out = gate.validate(df, {"expectations": [{"expectation_type": f"expect_{n}", "kwargs": k} for n, k in checks]})
    return [r["success"] for r in out.results], out


@pytest.mark.parametrize("held", [10, 10_000])
def test_breaks_within_and_between_ranges(spark, held):
    rng = random.Random(1)
    values = [None if rng.random() < 0.1 else i // 3 - (5 if rng.random() < 0.05 else 0) for i in range(600)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "at int, v int").repartition(5)
    there = [v for v in values if v is not None]
    for good, plain in ((lambda a, b: a <= b, lambda a, b: a <= b), (lambda a, b: a < b, lambda a, b: a < b), (lambda a, b: a >= b, lambda a, b: a >= b)):
        want = sum(not plain(a, b) for a, b in zip(there, there[1:], strict=False))
        assert gate.order_breaks(df, "v", ["at"], good, held) == (want, len(there) - 1)


def test_order_expectations(spark):
    df = spark.range(100).select("id", (-F.col("id")).alias("down"), (F.col("id") % 10).alias("saw"), F.lit(None).cast("int").alias("empty"))
    got, _ = run(
        df,
        ("column_values_to_be_increasing", {"column": "id", "order_by": "id", "strictly": True}),
        ("column_values_to_be_increasing", {"column": "down", "order_by": "id"}),
        ("column_values_to_be_decreasing", {"column": "down", "order_by": ["id"]}),
        ("column_values_to_be_increasing", {"column": "saw", "order_by": "id", "mostly": 0.9}),
        ("column_values_to_be_increasing", {"column": "saw", "order_by": "id", "mostly": 0.95}),
        ("column_values_to_be_increasing", {"column": "empty", "order_by": "id"}),
        ("column_values_to_be_increasing", {"column": "id"}),
    )
    assert got == [True, False, True, True, False, True, False]


def test_distribution_expectations(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("d"), (F.col("id") / 1000).alias("u"), F.when(F.col("id") < 500, "a").when(F.col("id") < 800, "b").otherwise("c").alias("s"))
    three = {"values": ["a", "b", "c"], "weights": [0.5, 0.3, 0.2]}
    off = {"values": ["a", "b", "c"], "weights": [0.4, 0.3, 0.3]}
    short = {"values": ["a", "b"], "weights": [0.6, 0.4]}
    even, bent = {"bins": [0, 0.25, 0.5, 0.75, 1.0], "weights": [0.25] * 4}, {"bins": [0, 0.5, 1.0], "weights": [0.56, 0.44]}
    got, out = run(
        df,
        ("column_kl_divergence_to_be_less_than", {"column": "s", "partition_object": three, "threshold": 1e-9}),
        ("column_kl_divergence_to_be_less_than", {"column": "s", "partition_object": off, "threshold": 0.02}),
        ("column_kl_divergence_to_be_less_than", {"column": "s", "partition_object": short, "threshold": 100}),
        ("column_ks_test_p_value_to_be_greater_than", {"column": "u", "partition_object": even}),
        ("column_ks_test_p_value_to_be_greater_than", {"column": "u", "partition_object": bent, "p_value": 0.001}),
        ("column_ks_test_p_value_to_be_greater_than", {"column": "u", "partition_object": bent, "p_value": 0.01}),
        ("column_chisquare_test_p_value_to_be_greater_than", {"column": "s", "partition_object": three}),
        ("column_chisquare_test_p_value_to_be_greater_than", {"column": "s", "partition_object": off}),
        ("column_chisquare_test_p_value_to_be_greater_than", {"column": "s", "partition_object": {"values": ["a"], "weights": [0.5]}}),
        ("column_kl_divergence_to_be_less_than", {"column": "nothing", "partition_object": three, "threshold": 1}),
    )
    assert got == [True, False, False, True, True, False, True, False, False, False]
    assert out.results[0]["observed"] == [500, 300, 200, 1000]


def test_statistics_by_known_values():
    assert abs(gate.divergence([500, 300, 200], 1000, [0.4, 0.3, 0.3]) - (0.5 * math.log(1.25) + 0.2 * math.log(2 / 3))) < 1e-12
    assert gate.divergence([1, 1], 3, [0.5, 0.5]) == gate.divergence([1, 1], 2, [1.0, 0.0]) == math.inf
    for x, chance in ((1.2238, 0.1), (1.3581, 0.05), (1.6276, 0.01)):
        assert abs(gate.kolmogorov([round((0.5 + x / 100) * 10_000), 10_000 - round((0.5 + x / 100) * 10_000)], 10_000, [0.5, 0.5])[1] - chance) < 2e-3
    # Two degrees of freedom: exp(-x); one: erfc(sqrt(x)); many against a sum of Poisson terms.
    for x in (0.01, 0.5, 1.0, 3.0, 20.0, 200.0):
        assert abs(gate.upper_gamma(1, x) - math.exp(-x)) < 1e-12
        assert abs(gate.upper_gamma(0.5, x) - math.erfc(math.sqrt(x))) < 1e-10
        assert abs(gate.upper_gamma(8, x) - sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(8))) < 1e-10
    assert gate.upper_gamma(3, 0) == 1
