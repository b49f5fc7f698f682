"""Reproducible sampling: order by a hash of seed and key, take the first rows.

The hash is MD5 of ``seed|key``, so any engine can replay a draw.  The first n by
hash are found by counting rows in cells of equal hash ranges: whole cells before
the cut are taken, and only the cell that holds the cut is ordered.  No sample
ends in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import HELD, col, existing, is_orderless, numeric_columns, string_columns, unused, with_stats
from ..functions.tables import settled

#: Smaller tables are returned whole.
SMALLEST = 10
#: Hexadecimal digits of a draw key that name its cell.
CELL_DIGITS = 4
#: Cells of an importance sample in one unit of its ranks, which are logarithms: a few hundred thousand in all.
RANK_CELLS = 4096
# Normal quantiles of the confidence levels.
Z_SCORES = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
DRIFT_LIMIT = 0.1
TVD_LIMIT = 0.05


def target_size(n: int, size: float | int = 0.1) -> int:
    """Rows wanted: a float up to 1 is a share (at least one row), anything else a count."""
    if isinstance(size, float) and 0 < size <= 1:
        return max(1, round(n * size))
    return max(1, int(size))


def draw_key(keys: Sequence[str], seed: int) -> Column:
    """Hash-random text key of a row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of a draw key."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _keys(df: DataFrame, keys: Sequence[str] | None) -> list[str]:
    kinds = {f.name: f.dataType for f in df.schema}
    return existing(df, keys) or [c for c in df.columns if not is_orderless(kinds[c])]


def random_sample(df: DataFrame, n: int, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all) without replacement."""
    k = _keys(df, keys)
    draw = draw_key(k, seed)
    # At most 16 ** CELL_DIGITS cells, whatever the table.
    return _first(df, n, draw, F.substring(draw, 1, CELL_DIGITS), k)


def _first(df: DataFrame, n: int, draw: Column, cell: Column, keys: Sequence[str]) -> DataFrame:
    """The ``n`` rows least by ``draw`` and ``keys``; ``cell`` must not fall where ``draw`` grows, and has few values."""
    t = unused(df, "draw")
    rows = df.withColumn(t, F.struct(draw.alias("key"), cell.alias("cell")))
    cells = rows.groupBy(F.col(f"{t}.cell").alias("cell")).agg(F.count("*").alias("n"))
    upto = cells.select("cell", "n", F.sum("n").over(Window.orderBy("cell")).alias("upto"))
    cut = upto.filter(F.col("upto") >= n).agg(F.min(F.struct("cell", (F.lit(n) - F.col("upto") + F.col("n")).alias("rest"))).alias(f"{t}_cut"))
    return _before_cut(with_stats(rows, cut), t, [], keys).select(*map(col, df.columns))


def _before_cut(rows: DataFrame, t: str, by: list[Column], keys: Sequence[str]) -> DataFrame:
    """Rows of cells before ``<t>_cut.cell`` and the first ``<t>_cut.rest`` of that cell; all without a cut."""
    mine, cut, place = F.col(f"{t}.cell"), F.col(f"{t}_cut"), f"{t}_place"
    near = rows.filter(cut.isNull() | (mine <= cut["cell"]))
    number = F.row_number().over(Window.partitionBy(*by, mine).orderBy(f"{t}.key", *map(col, keys)))
    return near.withColumn(place, number).filter(cut.isNull() | (mine < cut["cell"]) | (F.col(place) <= cut["rest"]))


def reservoir_sample(df: DataFrame, n: int, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """A uniform sample of exactly ``min(n, rows)``: the bottom n by hash have a reservoir's distribution."""
    return random_sample(df, n, keys, seed)


def stratified_sample(df: DataFrame, n: int, stratum: str, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Proportional quotas, at least one row a stratum and at most all; null strata are left out.

    A missing column means a simple random sample.
    """
    if stratum not in df.columns:
        return random_sample(df, n, keys, seed)
    k, t = _keys(df, keys), unused(df, "draw")
    known = df.filter(col(stratum).isNotNull())
    draw = draw_key(k, seed)
    rows = known.withColumn(t, F.struct(draw.alias("key"), F.substring(draw, 1, CELL_DIGITS).alias("cell")))
    # One row per stratum and cell at most: sizes and places come from these, not from the rows.
    cells = rows.groupBy(col(stratum).alias("s"), F.col(f"{t}.cell").alias("cell")).agg(F.count("*").alias("n"))
    sizes = cells.groupBy("s").agg(F.sum("n").alias("size"))
    quota = F.least(F.col("size"), F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("size") / F.col("total")).cast("long")))
    quotas = with_stats(sizes, df.agg(F.count("*").alias("total"))).select("s", quota.alias("quota"))
    upto = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("cell"))).join(quotas, "s")
    cuts = upto.filter("upto >= quota").groupBy("s").agg(F.min(F.struct("cell", (F.col("quota") - F.col("upto") + F.col("n")).alias("rest"))).alias(f"{t}_cut"))
    cuts = cuts.withColumnRenamed("s", f"{t}_s")
    return _before_cut(rows.join(cuts, col(stratum) == F.col(f"{t}_s")), t, [F.col(f"{t}_s")], k).select(*map(col, df.columns))


def with_row_id(df: DataFrame, order_by: Sequence[str], name: str = "_row_id") -> DataFrame:
    """Consecutive numbers from 0 in the order of columns, without one task for all rows.

    Over ``HELD`` rows are dealt out by range, sorted and written once with the
    number of their range and their place in it; a row's number is that place and
    the sizes of the ranges before.  There are as many ranges as the session has
    shuffle partitions.  The order must be total.
    """
    at = unused(df, "place")
    keys = [col(c) for c in order_by]
    if df.count() <= HELD:
        return df.withColumn(at, F.row_number().over(Window.orderBy(*keys))).select(*map(col, df.columns), (F.col(at) - 1).cast("long").alias(name))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    rows, part = settled(ranged), F.shiftright(at, 33)  # the range is above the place's 33 bits
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = before.select(F.struct("part", "before").alias(f"{at}_start"))
    joined = rows.join(F.broadcast(starts), part == F.col(f"{at}_start.part"))
    return joined.select(*map(col, df.columns), (F.col(f"{at}_start.before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def systematic_sample(df: DataFrame, order_by: Sequence[str], n: int | None = None, step: int | None = None) -> DataFrame:
    """Rows 0, step, 2 step ... in the given order; the step is ``rows // n`` unless given."""
    if step is None:
        step = max(1, df.count() // max(1, n or 1))
    number = unused(df, "row_id")
    return with_row_id(df, order_by, number).filter(F.col(number) % step == 0).drop(number)


def importance_sample(df: DataFrame, n: int, weight: str | Column, keys: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows drawn one after the other by weight, without replacement: least ``-ln(u) / w`` first.

    Weights that are no numbers count 0.  All weights 0 means a simple random
    sample; a negative one, or fewer positive ones than rows wanted, is an error.
    """
    k = _keys(df, keys)
    w = F.coalesce(F.expr(f"try_cast(`{weight}` as double)") if isinstance(weight, str) else weight.cast("double"), F.lit(0.0))
    seen = df.agg(F.min(w).alias("least"), F.count_if(w > 0).alias("positive"), F.count("*").alias("rows"), F.sum(w).alias("total")).first()
    if seen["rows"] and seen["least"] < 0:
        raise ValueError("weights must not be negative")
    if not seen["total"]:
        return random_sample(df, n, keys, seed)
    n = min(n, seen["rows"])
    if seen["positive"] < n:
        raise ValueError("fewer rows with a positive weight than rows to draw")
    # The logarithm of -ln(u) / w: it keeps its digits for weights of any size.
    rank = F.ln(-F.ln(uniform(draw_key(k, seed)))) - F.ln(w)
    return _first(df.filter(w > 0), n, rank, F.floor(rank * RANK_CELLS), k)


def sample_size(population: int, confidence: float = 0.95, margin: float = 0.05, proportion: float = 0.5) -> dict:
    """Rows for a margin of error, with the finite correction; unknown confidences use 1.96."""
    z = Z_SCORES.get(confidence, 1.96)
    base = z * z * proportion * (1 - proportion) / margin**2
    needed = min(population, math.ceil(base / (1 + (base - 1) / population))) if population > 0 else 0
    return {"sample_size": needed, "sampling_ratio": round(needed / population, 4) if population else 0.0, "z_score": z, "confidence": confidence, "margin": margin}


def mean_drift(df: DataFrame, sample: DataFrame) -> DataFrame:
    """``column, drift, biased``: distance of means in deviations of the original (1 for a zero deviation)."""
    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, drift double, biased boolean")
    whole = df.agg(*[x for i, n in enumerate(names) for x in (F.avg(col(n)).alias(f"m{i}"), F.stddev_samp(col(n)).alias(f"s{i}"))])
    part = sample.agg(*[F.avg(col(n)).alias(f"p{i}") for i, n in enumerate(names)])
    rows = [F.struct(F.lit(n).alias("column"), F.round(F.abs(F.col(f"m{i}") - F.col(f"p{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0), 6).alias("drift")) for i, n in enumerate(names)]
    return whole.join(F.broadcast(part)).select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("biased", F.col("drift") > DRIFT_LIMIT)


def category_distance(df: DataFrame, sample: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``column, tvd, biased``: half the summed differences of shares over the union of values, nulls left out."""
    names = list(names if names is not None else string_columns(df))

    def shares(table: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("value")) for n in names])
        counts = table.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
        totals = counts.groupBy("column").agg(F.sum("n").alias("t"))
        return counts.join(totals, "column").select("column", "value", (F.col("n") / F.col("t")).alias(name))

    if not names:
        return df.sparkSession.createDataFrame([], "column string, tvd double, biased boolean")
    both = shares(df, "p").join(shares(sample, "q"), ["column", "value"], "full_outer")
    gap = F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2
    return both.groupBy("column").agg(F.round(gap, 6).alias("tvd")).withColumn("biased", F.col("tvd") > TVD_LIMIT)


@dataclass
class Sample:
    dataframe: DataFrame
    strategy: str
    original_rows: int
    sampled_rows: int
    sampling_ratio: float
    bias: dict[str, DataFrame]


def sample(df: DataFrame, config: dict) -> Sample:
    """By ``strategy``: random, stratified, systematic, importance, reservoir; with sizes and bias tables."""
    strategy, rows = config.get("strategy", "random"), df.count()
    if rows < SMALLEST:
        return Sample(df, strategy, rows, rows, 1.0, {})
    n = min(rows, target_size(rows, config.get("sample_size", 0.1)))
    keys, seed = config.get("keys"), config.get("random_seed", 42)
    if strategy == "random":
        out = random_sample(df, n, keys, seed)
    elif strategy == "stratified":
        out = stratified_sample(df, n, config.get("stratify_column", ""), keys, seed)
    elif strategy == "systematic":
        out = systematic_sample(df, keys or _keys(df, None), n, config.get("step"))
    elif strategy == "importance":
        out = importance_sample(df, n, config.get("weight_column") or config["weight_function"], keys, seed)
    elif strategy == "reservoir":
        out = reservoir_sample(df, n, keys, seed)
    else:
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    got = out.count()
    return Sample(out, strategy, rows, got, round(got / rows, 4), {"mean_drift": mean_drift(df, out), "category_distance": category_distance(df, out)})
