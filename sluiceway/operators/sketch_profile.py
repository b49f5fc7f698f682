"""Profiles that can be added up: one state per column and batch, merged without the rows.

A state holds counts, ends, mean and squared deviations exactly, and sketches for
what can't be added up exactly: HyperLogLog for distinct values, KLL for quantiles,
a frequent-items sketch for the commonest texts.  A delta is profiled by itself, and
a dataset's profile is the merged states of its batches; the sketches' error bounds
stand beside their answers.  The exact profile (:mod:`sluiceway.operators.profile`)
stays for whoever can pay for all the passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, is_numeric, is_orderless

#: log2 of the registers of a distinct sketch; its relative standard error is 1.04 / sqrt(registers).
REGISTERS = 12
DISTINCT_ERROR = round(1.04 / 2 ** (REGISTERS / 2), 4)
#: Size of a quantile sketch, and the error in rank that it stays under with 99 %.
QUANTILE_SIZE = 800
RANK_ERROR = 0.004
#: Values that a frequent-items sketch follows; a count is off by at most this share of the rows.
ITEMS = 1_000
COUNT_ERROR = round(3.5 / ITEMS, 4)

STATE = "place int, column string, dtype string, rows bigint, count bigint, low double, high double, first string, last string, mean double, spread double, distinct binary, quantiles binary, items struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"

NAMES = ("place", "column", "dtype", "rows", "count", "low", "high", "first", "last", "mean", "spread", "distinct", "quantiles", "items")


def _as_number(kind: T.DataType, c: Column) -> Column:
    return c.cast("double") if is_numeric(kind) else F.lit(None).cast("double")


def profile_states(df: DataFrame) -> DataFrame:
    """One row per column of a table or batch: its state, from one aggregate.

    NaN counts as a value in counts and is passed over in numbers; nested columns
    have counts only.
    """
    stats: list[Column] = [F.count("*").alias("rows")]
    fields = []
    for i, f in enumerate(df.schema):
        c, number = col(f.name), F.nanvl(_as_number(f.dataType, col(f.name)), F.lit(None).cast("double"))
        text = c.cast("string") if not is_orderless(f.dataType) else F.lit(None).cast("string")
        stats += [F.count(c).alias(f"n{i}"), F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), F.avg(number).alias(f"m{i}"), (F.var_pop(number) * F.count(number)).alias(f"s{i}")]
        own = c if not is_orderless(f.dataType) else F.lit(None).cast("string")
        stats += [F.min(own).cast("string").alias(f"a{i}"), F.max(own).cast("string").alias(f"b{i}")]
        stats += [F.hll_sketch_agg(text, F.lit(REGISTERS)).alias(f"d{i}"), F.kll_sketch_agg_double(number, F.lit(QUANTILE_SIZE)).alias(f"q{i}")]
        stats += [F.call_function("approx_top_k_accumulate", F.when(F.lit(not is_numeric(f.dataType)), text), F.lit(ITEMS)).alias(f"t{i}")]
        values = {"place": F.lit(i), "column": F.lit(f.name), "dtype": F.lit(f.dataType.simpleString()), "rows": F.col("rows"), "count": F.col(f"n{i}"), "low": F.col(f"lo{i}"), "high": F.col(f"hi{i}"), "first": F.col(f"a{i}"), "last": F.col(f"b{i}"), "mean": F.col(f"m{i}"), "spread": F.col(f"s{i}"), "distinct": F.col(f"d{i}"), "quantiles": F.col(f"q{i}"), "items": F.col(f"t{i}")}
        fields.append(F.struct(*[v.alias(n) for n, v in values.items()]))
    if not fields:
        return df.sparkSession.createDataFrame([], STATE)
    return df.agg(*stats).select(F.explode(F.array(*fields)).alias("r")).select("r.*")


def merged(states: DataFrame) -> DataFrame:
    """States of the same columns added up: one row a column, a state itself.

    Texts' ends are by code point; numbers' ends are in ``low`` and ``high``.
    """
    n = F.when(F.col("mean").isNotNull(), F.col("count"))
    whole = F.sum(n * F.col("mean")) / F.sum(n)
    squares = F.sum(F.col("spread") + n * F.col("mean") * F.col("mean"))
    out = states.groupBy("column").agg(
        F.min("place").alias("place"), F.max("dtype").alias("dtype"), F.sum("rows").alias("rows"), F.sum("count").alias("count"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"),
        whole.alias("mean"), F.greatest(F.lit(0.0), squares - F.sum(n) * whole * whole).alias("spread"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.call_function("approx_top_k_combine", F.col("items"), F.lit(ITEMS)).alias("items"),
    )
    return out.select(*NAMES)


def estimates(states: DataFrame, top: int = 20) -> DataFrame:
    """What states say: exact ``count, missing, min, max, mean, std``, and estimated ``cardinality, q1, median, q3, top_values`` with their error bounds."""
    number = F.col("low").isNotNull()
    quartiles = F.call_function("kll_sketch_get_quantile_double", F.col("quantiles"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    guarded = F.when(number, quartiles)
    common = F.call_function("approx_top_k_estimate", F.col("items"), F.lit(top))
    return states.select(
        "place",
        "column",
        "dtype",
        "count",
        (F.col("rows") - F.col("count")).alias("missing"),
        F.when(number, F.col("low").cast("string")).otherwise(F.col("first")).alias("min"),
        F.when(number, F.col("high").cast("string")).otherwise(F.col("last")).alias("max"),
        "mean",
        F.when(number & (F.col("count") > 1), F.sqrt(F.col("spread") / (F.col("count") - 1))).alias("std"),
        F.hll_sketch_estimate("distinct").alias("cardinality"),
        F.lit(DISTINCT_ERROR).alias("cardinality_error"),
        F.get(guarded, F.lit(0)).alias("q1"),
        F.get(guarded, F.lit(1)).alias("median"),
        F.get(guarded, F.lit(2)).alias("q3"),
        F.lit(RANK_ERROR).alias("rank_error"),
        F.transform(common, lambda x: F.struct(x["item"].cast("string").alias("value"), x["count"].alias("count"))).alias("top_values"),
        F.lit(COUNT_ERROR).alias("count_error"),
    )
