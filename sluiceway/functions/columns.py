"""Types, names and statistics of columns."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Factor of the interquartile range beyond which a value is an outlier.
IQR_FACTOR = 1.5
#: Most values of a column that one exact aggregate holds; more are narrowed down first.
HELD = 200_000
#: Accuracy of the sketches that narrow down.
SKETCH = 10_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(quoted(name))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it: one that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def existing(df: DataFrame, names: Iterable[str] | None) -> list[str]:
    """Those of ``names`` that ``df`` has, in the order given."""
    have = set(df.columns)
    return [n for n in names or () if n in have]


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_orderless(kind: T.DataType) -> bool:
    """Kinds that statistics on values make no sense for."""
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns; booleans aren't."""
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def null_for_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column, so that aggregates skip it."""
    change = {f.name: F.nanvl(col(f.name), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(change) if change else df


def quantiles(name: str, points: tuple[float, ...] = (0.25, 0.5, 0.75), approx: bool = False) -> Column:
    """Quantiles with linear interpolation as one aggregate, or approximate ones."""
    array = F.array(*[F.lit(p) for p in points])
    return F.percentile_approx(col(name), array, 100_000) if approx else F.percentile(col(name), array)


@dataclass
class _Search:
    """The open interval (low, high), None for no end, that holds the value of a rank; rows under it and inside it."""

    column: str
    rank: int
    below: int
    inside: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def interval(self) -> tuple[str, float | None, float | None]:
        return self.column, self.low, self.high

    def narrow(self, low: float, high: float, under: int, to_low: int, to_high: int, within: int) -> None:
        """Take in how many rows inside are less than ``low``, at most ``low``, less than ``high`` and at most ``high``."""
        place = self.rank - self.below
        if place < under:
            self.high, self.inside = low, under
        elif place < to_low:
            self.value = low
        elif place < to_high:
            self.low, self.high, self.below, self.inside = low, high, self.below + to_low, to_high - to_low
        elif place < within:
            self.value = high
        else:
            self.low, self.below, self.inside = high, self.below + within, self.inside - within


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int], held: int = HELD) -> dict[tuple[str, int], float]:
    """The values at ``ranks`` (from 0, nulls left out) of numeric columns that have ``counts`` values.

    Rounds of one aggregate each close in on a value: a sketch proposes two
    values beside the rank, exact counts say where the rank is.  An interval
    shrinks to about a thousandth a round; once it holds at most ``held`` rows,
    an exact aggregate ends it, for at most four times that at once.  So no task keeps
    more values than that, and rows are never shuffled.
    """
    searches = [_Search(c, r, 0, counts[c]) for c, wanted in ranks.items() for r in sorted(set(wanted))]
    while open_ones := [s for s in searches if s.value is None]:
        groups: dict[tuple, list[_Search]] = {}
        for s in open_ones:
            groups.setdefault(s.interval(), []).append(s)
        few, room = [], 4 * held
        for g in groups.values():
            if g[0].inside <= min(held, room):
                few.append(g)
                room -= g[0].inside
        if few:
            found = df.agg(*[F.transform(F.array(*[F.lit(s.rank - s.below) for s in g]), partial(F.get, F.sort_array(F.collect_list(_inside(*g[0].interval()))))).alias(f"v{i}") for i, g in enumerate(few)]).first()
            for values, g in zip(found, few, strict=True):
                for value, s in zip(values, g, strict=True):
                    s.value = value
            continue
        sketches, slack = [], 3 / SKETCH
        for i, (interval, g) in enumerate(groups.items()):
            places = [(s.rank - s.below) / s.inside for s in g]
            points = F.array(*[F.lit(min(1.0, max(0.0, at + d))) for at in places for d in (-slack, slack)])
            sketches.append(F.percentile_approx(_inside(*interval), points, SKETCH).alias(f"b{i}"))
        proposed = dict(zip(groups, df.agg(*sketches).first(), strict=True))
        asked = sorted({(interval, v) for interval, values in proposed.items() for v in values}, key=str)
        sums = [F.count_if(x).alias(f"{n}{i}") for i, (interval, v) in enumerate(asked) for n, x in (("under", _inside(*interval) < v), ("upto", _inside(*interval) <= v))]
        seen = df.agg(*sums).first()
        under, upto = ({key: seen[f"{n}{i}"] for i, key in enumerate(asked)} for n in ("under", "upto"))
        for interval, g in groups.items():
            for j, s in enumerate(g):
                low, high = proposed[interval][2 * j : 2 * j + 2]
                s.narrow(low, high, under[interval, low], upto[interval, low], under[interval, high], upto[interval, high])
    return {(s.column, s.rank): s.value for s in searches}


def _inside(column: str, low: float | None, high: float | None) -> Column:
    """The column's value where it lies in the open interval, else null."""
    c = col(column).cast("double")
    if low is None and high is None:
        return c
    return F.when((c > low if low is not None else F.lit(True)) & (c < high if high is not None else F.lit(True)), c)


def exact_quantiles(df: DataFrame, names: Iterable[str], points: tuple[float, ...], held: int = HELD, approx: bool = False) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation of numeric columns, None for a column without values.

    Up to ``held`` values of a column are one exact aggregate; beyond that each
    order statistic is searched for (see :func:`order_statistics`).  ``approx``
    takes a sketch's answers instead.  Only these numbers reach the driver.
    """
    names = list(names)
    if not names:
        return {}
    if approx:
        row = df.agg(*[quantiles(n, points, True).alias(f"q{i}") for i, n in enumerate(names)]).first()
        return {n: [None if row[i] is None else float(v) for v in row[i]] if row[i] is not None else [None] * len(points) for i, n in enumerate(names)}
    counted = df.agg(*[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)]).first()
    counts = {n: counted[i] for i, n in enumerate(names)}
    out: dict[str, list[float | None]] = {n: [None] * len(points) for n in names}
    small = [n for n in names if 0 < counts[n] <= held]
    if small:
        row = df.agg(*[quantiles(n, points).alias(f"q{i}") for i, n in enumerate(small)]).first()
        out |= {n: [float(v) for v in row[i]] for i, n in enumerate(small)}
    large = {n: [p * (counts[n] - 1) for p in points] for n in names if counts[n] > held}
    if large:
        found = order_statistics(df, {n: [k for at in places for k in (math.floor(at), math.ceil(at))] for n, places in large.items()}, counts, held)
        for n, places in large.items():
            ends = [(at, math.floor(at), math.ceil(at)) for at in places]
            out[n] = [found[n, lo] if lo == hi else (hi - at) * found[n, lo] + (at - lo) * found[n, hi] for at, lo, hi in ends]
    return out


def modes(df: DataFrame, names: list[str], aliases: list[str]) -> DataFrame:
    """One row with the commonest value of each column, ties to the smallest; null without values.

    Values are counted in one shuffle over all columns, and only a best one a
    task comes together, so no task holds all values of a column.
    """
    sets = df.select(*[col(n).alias(f"__m{i}") for i, n in enumerate(names)])
    columns = [F.col(f"__m{i}") for i in range(len(names))]
    counted = sets.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("__n"), *[F.grouping(c).alias(f"__g{i}") for i, c in enumerate(columns)])
    best = [F.min(F.when((F.col(f"__g{i}") == 0) & c.isNotNull(), F.struct((-F.col("__n")).alias("n"), c.alias("v")))).getField("v").alias(a) for i, (c, a) in enumerate(zip(columns, aliases, strict=True))]
    return counted.agg(*best)


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` with the one row of ``stats`` (a global aggregate) beside each of its rows."""
    return df.join(F.broadcast(stats))
