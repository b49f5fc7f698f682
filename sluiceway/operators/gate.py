"""Quality gate: expectation suites evaluated in one aggregate over the table."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import HELD, col
from ..functions.tables import settled

PASS_MARK = 0.8
# An expectation gives the aggregates it needs and a test of their values.
Parts = tuple[list[Column], Callable[[list], bool]]
EXPECTATIONS: dict[str, Callable[..., Parts]] = {}


def expectation(f: Callable[..., Parts]) -> Callable[..., Parts]:
    """Register under the function's own name with ``expect_`` in front."""
    EXPECTATIONS["expect_" + f.__name__] = f
    return f


def _within(value, low, high) -> bool:
    return value is not None and (low is None or value >= low) and (high is None or value <= high)


def _rows(good: Column, counted: Column, mostly: float = 1.0) -> Parts:
    """Share of counted rows that are good; none counted is a pass."""
    return [F.count_if(good & counted), F.count_if(counted)], lambda v: v[1] == 0 or v[0] / v[1] >= mostly


def _limits(value: Column, low, high) -> Parts:
    return [value], lambda v: _within(v[0], low, high)


def _limit_test(c: Column, low, high) -> Column:
    good = F.lit(True)
    if low is not None:
        good &= c >= low
    if high is not None:
        good &= c <= high
    return good


@expectation
def table_row_count_to_be_between(df, min_value=None, max_value=None) -> Parts:
    return _limits(F.count("*"), min_value, max_value)


@expectation
def table_row_count_to_equal(df, value) -> Parts:
    return _limits(F.count("*"), value, value)


@expectation
def table_column_count_to_equal(df, value) -> Parts:
    return [], lambda v: len(df.columns) == value


@expectation
def column_to_exist(df, column) -> Parts:
    return [], lambda v: column in df.columns


@expectation
def table_columns_to_match_set(df, column_set, exact_match=True) -> Parts:
    return [], lambda v: set(column_set) == set(df.columns) if exact_match else set(column_set) <= set(df.columns)


@expectation
def column_values_to_not_be_null(df, column, mostly=1.0) -> Parts:
    return _rows(col(column).isNotNull(), F.lit(True), mostly)


@expectation
def column_values_to_be_null(df, column, mostly=1.0) -> Parts:
    return _rows(col(column).isNull(), F.lit(True), mostly)


@expectation
def column_values_to_be_unique(df, column, mostly=1.0) -> Parts:
    if mostly >= 1.0:
        return [F.count_distinct(col(column)), F.count(col(column))], lambda v: v[0] == v[1]
    # Values that occur once can't be counted beside other aggregates; they get a column of their own.
    once = df.filter(col(column).isNotNull()).groupBy(col(column)).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == 1)).first()[0]
    return [F.count(col(column))], lambda v: v[0] == 0 or once / v[0] >= mostly


@expectation
def column_values_to_be_between(df, column, min_value=None, max_value=None, mostly=1.0) -> Parts:
    return _rows(_limit_test(col(column), min_value, max_value), col(column).isNotNull(), mostly)


@expectation
def column_values_to_be_in_set(df, column, value_set, mostly=1.0) -> Parts:
    return _rows(col(column).isin(list(value_set)), col(column).isNotNull(), mostly)


@expectation
def column_values_to_not_be_in_set(df, column, value_set, mostly=1.0) -> Parts:
    return _rows(~col(column).isin(list(value_set)), col(column).isNotNull(), mostly)


@expectation
def column_values_to_match_regex(df, column, regex, mostly=1.0) -> Parts:
    return _rows(col(column).cast("string").rlike(regex), col(column).isNotNull(), mostly)


@expectation
def column_values_to_not_match_regex(df, column, regex, mostly=1.0) -> Parts:
    return _rows(~col(column).cast("string").rlike(regex), col(column).isNotNull(), mostly)


@expectation
def column_value_lengths_to_be_between(df, column, min_value=None, max_value=None, mostly=1.0) -> Parts:
    return _rows(_limit_test(F.length(col(column)), min_value, max_value), col(column).isNotNull(), mostly)


@expectation
def column_mean_to_be_between(df, column, min_value=None, max_value=None) -> Parts:
    return _limits(F.avg(col(column)), min_value, max_value)


@expectation
def column_median_to_be_between(df, column, min_value=None, max_value=None) -> Parts:
    return _limits(F.median(col(column)), min_value, max_value)


@expectation
def column_min_to_be_between(df, column, min_value=None, max_value=None) -> Parts:
    return _limits(F.min(col(column)), min_value, max_value)


@expectation
def column_max_to_be_between(df, column, min_value=None, max_value=None) -> Parts:
    return _limits(F.max(col(column)), min_value, max_value)


@expectation
def column_sum_to_be_between(df, column, min_value=None, max_value=None) -> Parts:
    return _limits(F.sum(col(column)), min_value, max_value)


@expectation
def column_stdev_to_be_between(df, column, min_value=None, max_value=None) -> Parts:
    return _limits(F.stddev_samp(col(column)), min_value, max_value)


@expectation
def column_unique_value_count_to_be_between(df, column, min_value=None, max_value=None) -> Parts:
    return _limits(F.count_distinct(col(column)), min_value, max_value)


@expectation
def column_proportion_of_unique_values_to_be_between(df, column, min_value=None, max_value=None) -> Parts:
    return [F.count_distinct(col(column)), F.count(col(column))], lambda v: _within(v[0] / v[1] if v[1] else 0.0, min_value, max_value)


@expectation
def column_distinct_values_to_be_in_set(df, column, value_set) -> Parts:
    return _rows(col(column).isin(list(value_set)), col(column).isNotNull())


@expectation
def column_pair_values_a_to_be_greater_than_b(df, column_A, column_B, or_equal=False, mostly=1.0) -> Parts:  # noqa: N803
    a, b = col(column_A), col(column_B)
    return _rows(a >= b if or_equal else a > b, a.isNotNull() & b.isNotNull(), mostly)


@expectation
def compound_columns_to_be_unique(df, column_list) -> Parts:
    key = F.struct(*map(col, column_list))
    return [F.count_distinct(key), F.count("*")], lambda v: v[0] == v[1]


def order_breaks(df: DataFrame, column: str, order_by: Sequence[str], good: Callable[[Column, Column], Column], held: int = HELD) -> tuple[int, int]:
    """How many of a column's values, in the order given, don't stand right behind the value before; and how many have one before.

    Nulls are passed over.  Over ``held`` rows are dealt out by range and written;
    inside a range each value is held against the one before, and only the first
    and last value of each range come together for the comparisons between ranges.
    The order must be total.
    """
    rows = df.filter(col(column).isNotNull()).select(*[col(c).alias(f"o{i}") for i, c in enumerate(order_by)], col(column).alias("value"))
    keys = [f"o{i}" for i in range(len(order_by))]
    before = lambda window: F.lag("value").over(window)
    bad = lambda last: F.count_if(last.isNotNull() & ~good(last, F.col("value")))
    if rows.count() <= held:
        seen = rows.withColumn("last", before(Window.orderBy(*keys))).agg(bad(F.col("last")), F.count("last")).first()
        return seen[0], seen[1]
    ranged = settled(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    inside = ranged.withColumn("last", before(Window.partitionBy("part").orderBy("at"))).agg(bad(F.col("last")), F.count("last")).first()
    ends = ranged.groupBy("part").agg(F.min_by("value", "at").alias("value"), F.max_by("value", "at").alias("end"))
    between = ends.withColumn("last", F.lag("end").over(Window.orderBy("part"))).agg(bad(F.col("last")), F.count("last")).first()
    return inside[0] + between[0], inside[1] + between[1]


def _ordered(df: DataFrame, column: str, order_by: Sequence[str] | str, good: Callable[[Column, Column], Column], mostly: float) -> Parts:
    wrong, pairs = order_breaks(df, column, [order_by] if isinstance(order_by, str) else order_by, good)
    return [F.lit(pairs - wrong), F.lit(pairs)], lambda v: v[1] == 0 or v[0] / v[1] >= mostly


@expectation
def column_values_to_be_increasing(df, column, order_by, strictly=False, mostly=1.0) -> Parts:
    return _ordered(df, column, order_by, (lambda a, b: a < b) if strictly else (lambda a, b: a <= b), mostly)


@expectation
def column_values_to_be_decreasing(df, column, order_by, strictly=False, mostly=1.0) -> Parts:
    return _ordered(df, column, order_by, (lambda a, b: a > b) if strictly else (lambda a, b: a >= b), mostly)


def _cells(column: str, partition_object: dict) -> tuple[list[Column], list[float]]:
    """Counts of the values or bins of a described distribution, then of all values; and its weights.

    Bins are half open but for the last.  All cells are counted in the suite's one
    aggregate.
    """
    weights = [float(w) for w in partition_object["weights"]]
    if "values" in partition_object:
        tests = [col(column) == F.lit(v) for v in partition_object["values"]]
    else:
        edges = list(partition_object["bins"])
        pairs = list(zip(edges, edges[1:], strict=False))
        tests = [(col(column) >= a) & (col(column) <= b if i == len(pairs) - 1 else col(column) < b) for i, (a, b) in enumerate(pairs)]
    if len(tests) != len(weights) or any(w < 0 for w in weights) or abs(sum(weights) - 1) > 1e-6:
        raise ValueError("a distribution needs a weight for each value or bin, which add up to 1")
    return [*[F.count_if(t) for t in tests], F.count(col(column))], weights


def divergence(counts: list[int], total: int, weights: list[float]) -> float:
    """Kullback-Leibler divergence of what was counted from the weights; infinite where something has no weight."""
    if total > sum(counts):
        return math.inf
    return sum(math.inf if not w else n / total * math.log(n / total / w) for n, w in zip(counts, weights, strict=True) if n)


def kolmogorov(counts: list[int], total: int, weights: list[float]) -> tuple[float, float]:
    """Largest distance of the two distribution functions at the bins' ends, and the share of samples that come further off by chance."""
    distance, here, there = 0.0, 0.0, 0.0
    for n, w in zip(counts, weights, strict=True):
        here, there = here + n / total, there + w
        distance = max(distance, abs(here - there))
    distance = max(distance, 1 - sum(counts) / total)
    x = math.sqrt(total) * distance
    chance = 1.0 if x < 0.2 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))
    return distance, min(1.0, max(0.0, chance))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: the share of a chi-square of 2a degrees beyond 2x."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 10_000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    value = 0.0
    for n in range(int(200 + 10 * math.sqrt(x)), 0, -1):
        value = n * (a - n) / (x + 2 * n + 1 - a + value)
    return front / (x + 1 - a + value)


@expectation
def column_kl_divergence_to_be_less_than(df, column, partition_object, threshold) -> Parts:
    counted, weights = _cells(column, partition_object)
    return counted, lambda v: v[-1] == 0 or divergence(v[:-1], v[-1], weights) < threshold


@expectation
def column_ks_test_p_value_to_be_greater_than(df, column, partition_object, p_value=0.05) -> Parts:
    """Against a distribution described by bins: distances are taken at their ends."""
    counted, weights = _cells(column, partition_object)
    return counted, lambda v: v[-1] == 0 or kolmogorov(v[:-1], v[-1], weights)[1] > p_value


@expectation
def column_chisquare_test_p_value_to_be_greater_than(df, column, partition_object, p_value=0.05) -> Parts:
    counted, weights = _cells(column, partition_object)

    def test(v: list) -> bool:
        if not v[-1]:
            return True
        if v[-1] > sum(v[:-1]) or any(n and not w for n, w in zip(v, weights, strict=False)):
            return False
        known = [(n, w * v[-1]) for n, w in zip(v, weights, strict=False) if w]
        return upper_gamma((len(known) - 1) / 2, sum((n - e) ** 2 / e for n, e in known) / 2) > p_value if len(known) > 1 else True

    return counted, test


@dataclass
class Outcome:
    passed: bool
    quality_score: float
    results: list[dict] = field(default_factory=list)


def default_suite(df: DataFrame) -> dict:
    """At least one row, and every column exists."""
    checks = [{"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1}}]
    checks += [{"expectation_type": "expect_column_to_exist", "kwargs": {"column": c}} for c in df.columns]
    return {"expectations": checks}


def load_suite(spark, path: str) -> dict:
    """A suite from a JSON file in any store Spark reads; an unreadable one is empty."""
    try:
        return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except Exception:  # noqa: BLE001 - a missing or broken suite means the default one
        return {}


def validate(df: DataFrame, suite: dict | None = None, threshold: float = PASS_MARK) -> Outcome:
    """All expectations over one pass; unknown names, bad arguments and missing columns are failed results."""
    checks = (suite or {}).get("expectations") or default_suite(df)["expectations"]
    planned: list[tuple[dict, Parts | str, int]] = []
    aggregates: list[Column] = []
    for check in checks:
        name, args = check.get("expectation_type", ""), check.get("kwargs") or {}
        named = [args[k] for k in ("column", "column_A", "column_B") if k in args] + list(args.get("column_list", ()))
        made: Parts | str
        if (make := EXPECTATIONS.get(name.lower())) is None:
            made = f"unknown expectation {name}"
        elif name != "expect_column_to_exist" and (gone := [c for c in named if c not in df.columns]):
            made = f"no column {gone[0]}"
        else:
            try:
                made = make(df, **args)
                df.agg(F.count("*"), *made[0]).schema  # resolves names and types, runs nothing
            except Exception as problem:  # noqa: BLE001 - one bad expectation must not stop the others
                made = str(problem).splitlines()[0][:200]
        planned.append((check, made, len(aggregates)))
        if not isinstance(made, str):
            aggregates += made[0]
    try:
        values = list(df.agg(F.count("*").alias("n"), *[a.alias(f"v{i}") for i, a in enumerate(aggregates)]).first())[1:]
    except Exception as problem:  # noqa: BLE001 - a table that can't be read fails the gate
        return Outcome(False, 0.0, [{"expectation_type": "table_readable", "success": False, "details": str(problem).splitlines()[0][:200]}])
    results = []
    for check, made, at in planned:
        mine = [] if isinstance(made, str) else values[at : at + len(made[0])]
        ok = not isinstance(made, str) and bool(made[1](mine))
        results.append({"expectation_type": check.get("expectation_type", ""), "kwargs": check.get("kwargs") or {}, "success": ok, "observed": mine, "details": made if isinstance(made, str) else ""})
    score = round(sum(r["success"] for r in results) / len(results), 4) if results else 0.0
    return Outcome(score >= threshold, score, results)


def basic_checks(df: DataFrame) -> DataFrame:
    """``check_name, success``: the table has rows and no column is null throughout."""
    names = df.columns
    wide = df.agg(F.count("*").alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit("table_not_empty").alias("check_name"), (F.col("n") > 0).alias("success"))]
    rows += [F.struct(F.lit(f"{c}_not_all_null").alias("check_name"), (F.col(f"c{i}") > 0).alias("success")) for i, c in enumerate(names)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

