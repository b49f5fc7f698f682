"""Profiling: counts, numeric statistics, top values, histograms, outliers.

Numeric statistics of all columns come from one aggregate; distinct counts from
another (they expand rows); histograms and frequencies from one pass each over
``(column, bin or value)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import IQR_FACTOR, col, exact_quantiles, is_numeric, is_orderless, numeric_columns, with_stats

TOP = 20
BINS = 20
#: Share of distinct values under which a text column is categorical.
CATEGORICAL = 0.5


def semantic_types(df: DataFrame) -> DataFrame:
    """``column, dtype, semantic_type, cardinality`` (null for nested columns)."""
    cards = cardinality(df)
    n = df.agg(F.count("*").alias("n"))
    rows = [(i, f.name, f.dataType.simpleString(), "boolean" if isinstance(f.dataType, T.BooleanType) else "numeric" if is_numeric(f.dataType) else "datetime" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text" if isinstance(f.dataType, T.StringType) else "unknown") for i, f in enumerate(df.schema)]
    kinds = df.sparkSession.createDataFrame(rows, "place int, column string, dtype string, kind string")
    ratio = F.col("cardinality") / F.greatest(F.col("n"), F.lit(1))
    kind = F.when((F.col("kind") == "text") & (ratio < CATEGORICAL), "categorical").otherwise(F.col("kind"))
    return with_stats(kinds.join(cards, "column", "left"), n).select("column", "dtype", kind.alias("semantic_type"), "cardinality")


def cardinality(df: DataFrame, approx: bool = False) -> DataFrame:
    """``column, cardinality``: distinct values, nulls not counted."""
    names = [f.name for f in df.schema if not is_orderless(f.dataType)]
    count = F.approx_count_distinct if approx else F.count_distinct
    return _down(df.agg(*[count(col(n)).alias(f"c{i}") for i, n in enumerate(names)]), names, [("cardinality", "c", "bigint")])


def _down(wide: DataFrame, names: list[str], parts: list[tuple[str, str, str]]) -> DataFrame:
    """One row a column from one wide row whose fields are ``<prefix><place>``."""
    rows = [F.struct(F.lit(n).alias("column"), *[F.col(f"{p}{i}").cast(kind).alias(out) for out, p, kind in parts]) for i, n in enumerate(names)]
    if not rows:
        return wide.sparkSession.createDataFrame([], "column string, " + ", ".join(f"{o} {k}" for o, _, k in parts))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def numeric_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """``column, count, min, max, mean, std (sample), q1, median, q3`` of numeric columns."""
    names = numeric_columns(df)
    stats = []
    for i, n in enumerate(names):
        c = col(n).cast("double")
        stats += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")]
    wide = df.agg(*(stats or [F.count("*").alias("n")]))
    middles = exact_quantiles(df, names, (0.25, 0.5, 0.75), approx=approx)
    wide = wide.select("*", *[F.lit(v).cast("double").alias(f"{p}{i}") for i, n in enumerate(names) for p, v in zip("xyz", middles[n], strict=True)])
    return _down(wide, names, [("count", "n", "bigint"), ("min", "a", "double"), ("max", "b", "double"), ("mean", "m", "double"), ("std", "s", "double"), ("q1", "x", "double"), ("median", "y", "double"), ("q3", "z", "double")])


def missing_values(df: DataFrame) -> DataFrame:
    """``column, count, missing, missing_pct`` (two places, 0 for an empty table)."""
    names = df.columns
    wide = df.agg(F.count("*").alias("rows"), *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)])
    out = _down(wide.withColumns({f"r{i}": F.col("rows") for i in range(len(names))}), names, [("count", "n", "bigint"), ("rows", "r", "bigint")])
    gone = F.col("rows") - F.col("count")
    return out.select("column", "count", gone.alias("missing"), F.when(F.col("rows") > 0, F.round(gone / F.col("rows") * 100, 2)).otherwise(0.0).alias("missing_pct"))


def datetime_profile(df: DataFrame) -> DataFrame:
    """``column, count, min, max`` (texts) of date and time columns."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    stats = [x for i, n in enumerate(names) for x in (F.count(col(n)).alias(f"n{i}"), F.min(col(n)).alias(f"a{i}"), F.max(col(n)).alias(f"b{i}"))]
    return _down(df.agg(*(stats or [F.count("*").alias("n")])), names, [("count", "n", "bigint"), ("min", "a", "string"), ("max", "b", "string")])


def frequencies(df: DataFrame, names: list[str] | None = None, top: int = TOP) -> DataFrame:
    """``column, place, value, count, other_count``: the commonest values of non-numeric columns, ties by value."""
    names = names if names is not None else [f.name for f in df.schema if not is_numeric(f.dataType) and not is_orderless(f.dataType)]
    pairs = [F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("value")) for n in names]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, place int, value string, count bigint, other_count bigint")
    counted = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))
    # Only each task's own best can be among the best of all.
    salt = counted.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(64)))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "value"))
    few = salt.withColumn("place", best("column", "salt")).filter(F.col("place") <= top).withColumn("place", best("column")).filter(F.col("place") <= top)
    totals = counted.groupBy("column").agg(F.sum("count").alias("total"))
    listed = few.groupBy("column").agg(F.sum("count").alias("listed"))
    return few.join(totals, "column").join(listed, "column").select("column", "place", "value", "count", (F.col("total") - F.col("listed")).alias("other_count"))


def histograms(df: DataFrame, names: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """``column, bin, low, high, count``: equal-width bins, the last one closed; a constant gets one unit around it.

    Edges have six places.  Columns of nulls only give no rows.
    """
    names = names if names is not None else numeric_columns(df)
    stats = [x for i, n in enumerate(names) for x in (F.min(col(n).cast("double")).alias(f"a{i}"), F.max(col(n).cast("double")).alias(f"b{i}"))]
    ends = _down(df.agg(*(stats or [F.count("*").alias("n")])), names, [("lo", "a", "double"), ("hi", "b", "double")]).filter("lo is not null")
    flat = F.col("lo") == F.col("hi")
    ends = ends.select("column", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) / bins * i
    pairs = [F.struct(F.lit(n).alias("column"), col(n).cast("double").alias("x")) for n in names]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, count bigint")
    values = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter("x is not null")
    placed = values.join(F.broadcast(ends), "column").withColumn("bin", sum((F.when(F.col("x") >= edge(i), 1).otherwise(0) for i in range(1, bins)), F.lit(0)))
    counts = placed.groupBy("column", "bin").agg(F.count("*").alias("count"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    high = F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(edge(F.col("bin") + 1))
    return grid.join(counts, ["column", "bin"], "left").select("column", "bin", F.round(edge(F.col("bin")), 6).alias("low"), F.round(high, 6).alias("high"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def outliers(df: DataFrame, approx: bool = False) -> DataFrame:
    """``column, status, low, high, outliers, outlier_pct`` by 1.5 interquartile ranges; under 4 values: insufficient data."""
    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, status string, low double, high double, outliers bigint, outlier_pct double")
    quartiles = exact_quantiles(df, names, (0.25, 0.75), approx=approx)
    stats = []
    for i, n in enumerate(names):
        (q1, q3), c = quartiles[n], col(n).cast("double")
        low, high = (None, None) if q1 is None else (q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1))
        stats += [F.count(c).alias(f"n{i}"), F.lit(low).cast("double").alias(f"a{i}"), F.lit(high).cast("double").alias(f"b{i}")]
        stats += [F.count_if((c < F.lit(low).cast("double")) | (c > F.lit(high).cast("double"))).alias(f"o{i}")]
    flat = _down(df.agg(*stats), names, [("count", "n", "bigint"), ("low", "a", "double"), ("high", "b", "double"), ("beyond", "o", "bigint")])
    enough = F.col("count") >= 4
    return flat.select(
        "column",
        F.when(enough, "ok").otherwise("insufficient data").alias("status"),
        F.when(enough, F.round("low", 6)).alias("low"),
        F.when(enough, F.round("high", 6)).alias("high"),
        F.when(enough, F.col("beyond")).alias("outliers"),
        F.when(enough, F.round(F.col("beyond") / F.col("count") * 100, 2)).alias("outlier_pct"),
    )


def row_count(df: DataFrame) -> DataFrame:
    """``rows, columns``: the table's size."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """All parts by name."""
    return {"size": row_count(df), "types": semantic_types(df), "numeric": numeric_profile(df), "missing": missing_values(df), "datetime": datetime_profile(df), "frequencies": frequencies(df), "histograms": histograms(df), "outliers": outliers(df)}
