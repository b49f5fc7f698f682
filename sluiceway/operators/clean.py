"""Cleaning: drop, deduplicate, impute, treat outliers, encode, normalise - in this order.

Each step is ``DataFrame -> DataFrame``.  Means and modes come from one row that
is broadcast, so plans stay lazy; quartiles, medians and one-hot encoding look at
the data while the plan is built.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import IQR_FACTOR, col, exact_quantiles, existing, is_numeric, is_orderless, modes, numeric_columns, unused, with_stats
from ..functions.tables import settled
from .sample import with_row_id

#: Most values that one-hot encoding makes columns of; more is an error, not a truncation.
ONE_HOT_WIDTH = 1000


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without those of ``names`` that exist."""
    return df.drop(*existing(df, names))


def deduplicate(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row of each set of rows equal in ``subset`` (all columns by default); nulls are equal.

    With a subset the first row by ``order_by`` stays, by the remaining columns
    where it is missing or ties.  Unknown names are left out of the subset.
    """
    keys = existing(df, subset)
    if not keys:
        return df.dropDuplicates()
    rest = existing(df, order_by)
    kinds = {f.name: f.dataType for f in df.schema}
    rest += [c for c in df.columns if c not in keys and c not in rest and not is_orderless(kinds[c])]
    first = Window.partitionBy(*map(col, keys)).orderBy(*map(col, rest or keys))
    place = unused(df, "place")
    return df.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(place)


def impute(df: DataFrame, strategy: str = "median") -> DataFrame:
    """Fill nulls: ``mean``, ``median`` or ``mode`` in numeric columns and the mode in others; ``drop`` rows; ``none``.

    Ties of the mode go to the smallest value.  A numeric column of nulls only
    becomes 0 by mode and stays null otherwise; an unknown strategy means mode.
    Mean and median make every integer column double, so the schema doesn't hang
    on whether it happens to hold nulls.
    """
    if strategy in ("none", None):
        return df
    if strategy == "drop":
        return df.na.drop("any")
    if strategy not in ("mean", "median", "mode"):
        warnings.warn(f"unknown imputation strategy {strategy!r}: mode is used", stacklevel=2)
    kinds = {f.name: f.dataType for f in df.schema if not is_orderless(f.dataType)}
    numeric = [n for n in kinds if is_numeric(kinds[n])] if strategy in ("mean", "median") else []
    common = [n for n in kinds if n not in numeric]
    fill: dict[str, Column] = {}
    filled = df
    if strategy == "median":
        middles = exact_quantiles(df, numeric, (0.5,))
        fill |= {n: F.coalesce(col(n).cast("double"), F.lit(middles[n][0]).cast("double")) for n in numeric}
    elif numeric:
        means = unused(df, "means")
        filled = with_stats(filled, df.agg(F.struct(*[F.avg(col(n)).alias(f"m{i}") for i, n in enumerate(numeric)]).alias(means)))
        fill |= {n: F.coalesce(col(n), F.col(means)[f"m{i}"]) for i, n in enumerate(numeric)}
    if common:
        best, aliases = unused(df, "best"), [f"v{i}" for i in range(len(common))]
        filled = with_stats(filled, modes(df, common, aliases).select(F.struct(*aliases).alias(best)))
        for n, a in zip(common, aliases, strict=True):
            zero = [F.lit(0).cast(kinds[n])] if is_numeric(kinds[n]) else []
            fill[n] = F.coalesce(col(n), F.col(best)[a], *zero)
    return filled.select(*[fill.get(n, col(n)).alias(n) for n in df.columns])


def iqr_bounds(df: DataFrame, names: Sequence[str], approx: bool = False) -> dict[str, tuple[float, float] | None]:
    """Ends of the usual range of each column, None for a column without values."""
    found = exact_quantiles(df, names, (0.25, 0.75), approx=approx)
    return {n: None if q1 is None else (q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)) for n, (q1, q3) in found.items()}


def treat_outliers(df: DataFrame, handling: str = "none", approx: bool = False) -> DataFrame:
    """``clip`` numeric values to 1.5 interquartile ranges around the quartiles, or ``remove`` rows outside.

    Bounds of all columns come from the same rows.  Removal keeps a row only if
    every numeric value is present and inside; anything else is no treatment.
    """
    names = numeric_columns(df)
    if handling not in ("clip", "remove") or not names:
        return df
    bounds = iqr_bounds(df, names, approx)
    if handling == "remove":
        inside = F.lit(True)
        for n in names:
            inside &= col(n).between(*map(F.lit, bounds[n])) if bounds[n] else F.lit(False)
        return df.filter(inside)
    change = {}
    for n in names:
        low, high = map(F.lit, bounds[n] or (None, None))
        change[n] = F.when(col(n).isNotNull(), F.greatest(F.least(col(n).cast("double"), high.cast("double")), low.cast("double")))
    return df.select(*[change.get(n, col(n)).alias(n) for n in df.columns])


def one_hot(df: DataFrame, name: str, width: int = ONE_HOT_WIDTH) -> DataFrame:
    """Boolean columns ``name_value`` in order of values in place of ``name``; nulls are false in all."""
    values = [r[0] for r in df.select(col(name)).filter(col(name).isNotNull()).distinct().orderBy(col(name)).limit(width + 1).collect()]
    if len(values) > width:
        raise ValueError(f"{name} has more than {width} values")
    kept = [col(c) for c in df.columns if c != name]
    return df.select(*kept, *[F.coalesce(col(name) == F.lit(v), F.lit(False)).alias(f"{name}_{v}") for v in values])


def label_encode(df: DataFrame, name: str) -> DataFrame:
    """Values become their place among the sorted distinct texts, from 0; null is the text ``None``.

    Only the distinct texts are ranked, in ranges; the map is joined back by equality.
    """
    text = F.coalesce(col(name).cast("string"), F.lit("None"))
    value, label, mine = (unused(df, n) for n in ("value", "label", "text"))
    places = with_row_id(df.select(text.alias(value)).distinct(), [value], label)
    joined = df.withColumn(mine, text).join(places, F.col(mine) == F.col(value))
    return joined.select(*[(F.col(label) if c == name else col(c)).alias(c) for c in df.columns])


def encode(df: DataFrame, encoding: dict[str, str] | None) -> DataFrame:
    """``onehot``, ``label`` or ``ordinal`` by column; unknown columns and methods are skipped."""
    for name, method in (encoding or {}).items():
        if name not in df.columns:
            warnings.warn(f"no column {name!r} to encode", stacklevel=2)
        elif method == "onehot":
            df = one_hot(df, name)
        elif method in ("label", "ordinal"):
            df = label_encode(df, name)
    return df


def normalise(df: DataFrame, methods: dict[str, str] | Sequence[str] | None) -> DataFrame:
    """``minmax`` to 0..1, or z-scores by population deviation; constant columns become 0, nulls stay.

    A list of names means ``minmax``; an unknown method means z-scores.
    """
    if methods and not isinstance(methods, dict):
        methods = dict.fromkeys(methods, "minmax")
    kinds = {f.name: f.dataType for f in df.schema}
    wanted = {}
    for name, method in (methods or {}).items():
        if name not in kinds or not is_numeric(kinds[name]):
            warnings.warn(f"no numeric column {name!r} to normalise", stacklevel=2)
        else:
            wanted[name] = method
    if not wanted:
        return df
    stats, change, held = [], {}, unused(df, "stats")
    for i, (name, method) in enumerate(wanted.items()):
        c, a, b = col(name).cast("double"), F.col(held)[f"a{i}"], F.col(held)[f"b{i}"]
        if method == "minmax":
            stats += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
            value = F.when(a == b, F.lit(0.0)).otherwise((c - a) / (b - a))
        else:
            stats += [F.avg(c).alias(f"a{i}"), F.stddev_pop(c).alias(f"b{i}")]
            value = F.when(b == 0, F.lit(0.0)).otherwise((c - a) / b)
        change[name] = F.when(c.isNotNull(), value)
    joined = with_stats(df, df.agg(F.struct(*stats).alias(held)))
    return joined.select(*[change.get(n, col(n)).alias(n) for n in df.columns])


def clean(df: DataFrame, config: dict | None = None) -> DataFrame:
    """All steps: ``drop_cols, dedup_subset, order_by, imputation_strategy, outlier_handling, encoding, normalize``.

    Medians and quartiles take several passes, so the rows left by deduplication
    are written once before them.
    """
    c = config or {}
    df = drop_columns(df, c.get("drop_cols", ()))
    df = deduplicate(df, c.get("dedup_subset"), c.get("order_by"))
    if c.get("imputation_strategy") == "median" or c.get("outlier_handling") in ("clip", "remove"):
        df = settled(df)
    df = impute(df, c.get("imputation_strategy", "none"))
    df = treat_outliers(df, c.get("outlier_handling", "none"))
    return normalise(encode(df, c.get("encoding")), c.get("normalize"))
