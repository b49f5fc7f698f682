"""Incremental loads: high-watermark deltas, keyed upserts and soft deletes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, existing, is_orderless, unused
from ..functions.tables import settled

EPOCH = "1970-01-01T00:00:00+00:00"
MODES = ("timestamp", "sequence", "soft_delete")


def watermark_value(df: DataFrame, column: str, mode: str) -> Column:
    """The column as a moment (unreadable: null) or, for sequences, a number (unreadable: 0)."""
    kind = df.schema[column].dataType
    if mode in ("timestamp", "soft_delete"):
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return col(column).cast("timestamp")
        return F.try_to_timestamp(col(column).cast("string"))
    return F.coalesce(F.expr(f"try_cast(`{column}` as bigint)"), F.lit(0).cast("bigint"))


def watermark_literal(value: str | int | None, mode: str) -> Column:
    if mode in ("timestamp", "soft_delete"):
        return F.lit(value or EPOCH).cast("timestamp")
    try:
        return F.lit(int(value or 0)).cast("bigint")
    except ValueError:
        return F.lit(0).cast("bigint")


def delta(source: DataFrame, column: str, watermark: str | int | None, mode: str = "timestamp", lateness: str | None = None) -> DataFrame:
    """Rows strictly above the watermark (less ``lateness``, such as ``2 hours``); without the column, all rows."""
    if column not in source.columns:
        return source
    low = watermark_literal(watermark, mode)
    if lateness and mode != "sequence":
        low = low - F.expr(f"interval {lateness}")
    return source.filter(watermark_value(source, column, mode) > low)


def new_watermark(rows: DataFrame, column: str, mode: str = "timestamp", *more: Column) -> DataFrame:
    """One row ``watermark`` (text): the largest value, the epoch or 0 where there is none; beside it ``more`` aggregates."""
    if column not in rows.columns:
        return rows.agg(F.max(F.lit(EPOCH)).alias("watermark"), *more).fillna(EPOCH, ["watermark"])
    top = F.max(watermark_value(rows, column, mode))
    if mode in ("timestamp", "soft_delete"):
        return rows.agg(F.coalesce(F.date_format(top, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit(EPOCH)).alias("watermark"), *more)
    return rows.agg(F.coalesce(top, F.lit(0)).cast("string").alias("watermark"), *more)


def latest(rows: DataFrame, keys: Sequence[str], column: str, mode: str = "timestamp") -> DataFrame:
    """The newest row of each key; ties go by the other columns, so reruns agree."""
    kinds = {f.name: f.dataType for f in rows.schema}
    rest = [col(c) for c in rows.columns if c not in keys and not is_orderless(kinds[c])]
    newest = [watermark_value(rows, column, mode).desc_nulls_last()] if column in rows.columns else []
    place = F.row_number().over(Window.partitionBy(*map(col, keys)).orderBy(*(newest + rest or [F.lit(1)])))
    at = unused(rows, "place")
    return rows.withColumn(at, place).filter(F.col(at) == 1).drop(at)


def deleted_flag(rows: DataFrame, column: str | None) -> Column:
    """The soft-delete flag as a boolean; unreadable values and a missing column mean not deleted."""
    if not column or column not in rows.columns:
        return F.lit(False)
    return F.coalesce(F.expr(f"try_cast(`{column}` as boolean)"), F.lit(False))


def upsert(staged: DataFrame, rows: DataFrame, keys: Sequence[str], overwrite_nulls: bool = False) -> DataFrame:
    """``staged`` with ``rows`` (one per key) merged in by one full outer join.

    Keys in both: values of ``rows`` win, nulls only with ``overwrite_nulls``.  Keys
    only in ``rows`` are added, with the columns only they have.
    """
    extra = [c for c in rows.columns if c not in staged.columns]
    in_s, in_d = unused(staged, "in_s"), unused(rows, "in_d")
    s = staged.withColumn(in_s, F.lit(True)).alias("s")
    d = rows.withColumn(in_d, F.lit(True)).alias("d")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"s.`{k}`").eqNullSafe(F.col(f"d.`{k}`"))
    joined = s.join(d, same, "full_outer")
    mine, theirs = lambda c: F.col(f"s.`{c}`"), lambda c: F.col(f"d.`{c}`")
    out = [F.coalesce(theirs(k), mine(k)).alias(k) for k in keys]
    for c in (c for c in staged.columns if c not in keys):
        if c not in rows.columns:
            value = mine(c)
        elif overwrite_nulls:
            value = F.when(theirs(in_d), theirs(c)).otherwise(mine(c))
        else:
            value = F.coalesce(theirs(c), mine(c))
        out.append(value.alias(c))
    # Columns only the delta has are filled for inserted rows only.
    out += [F.when(mine(in_s).isNull(), theirs(c)).alias(c) for c in extra]
    return joined.select(*out)


def remove_keys(staged: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``staged`` without the rows whose key occurs in ``gone``."""
    names = {k: unused(staged, f"gone_{i}") for i, k in enumerate(keys)}
    g = gone.select(*[col(k).alias(n) for k, n in names.items()]).distinct()
    same = F.lit(True)
    for k, n in names.items():
        same &= col(k).eqNullSafe(F.col(n))
    return staged.join(g, same, "left_anti")


def count_matches(rows: DataFrame, known: DataFrame, keys: Sequence[str]) -> int:
    """How many of ``rows`` have a key that occurs in ``known``; only key columns are read."""
    names = {k: unused(rows, f"known_{i}") for i, k in enumerate(keys)}
    there = known.select(*[col(k).alias(n) for k, n in names.items()])
    same = F.lit(True)
    for k, n in names.items():
        same &= col(k).eqNullSafe(F.col(n))
    return rows.select(*map(col, keys)).join(there, same, "left_semi").count()


@dataclass
class Load:
    dataframe: DataFrame
    inserted_rows: int
    updated_rows: int
    deleted_rows: int
    watermark: str


def load_delta(source: DataFrame, staged: DataFrame | None, config: dict, watermark: str | int | None = None) -> Load:
    """Filter, fold to the latest row of a key, delete, update, insert; the caller stores data first, then the watermark.

    Config: ``watermark_column, cdc_mode, primary_key (name or list),
    soft_delete_column, overwrite_nulls, allowed_lateness``.  Without a usable key
    all delta rows are appended.  An empty delta changes nothing.
    """
    mode = config.get("cdc_mode", "timestamp")
    mode = mode if mode in MODES else "sequence"
    column = config.get("watermark_column", "updated_at")
    keys = config.get("primary_key", "id")
    keys = [keys] if isinstance(keys, str) else list(keys)
    # The delta is written once: it is looked at for its size, its watermark, its keys and its rows.
    rows = settled(delta(source, column, watermark, mode, config.get("allowed_lateness")))
    flag = deleted_flag(rows, config.get("soft_delete_column", "is_deleted") if mode == "soft_delete" else None)
    seen = new_watermark(rows, column, mode, F.count("*").alias("rows"), F.count_if(flag).alias("flagged")).first()
    if not seen["rows"]:
        return Load(staged if staged is not None else rows, 0, 0, 0, str(watermark or (0 if mode == "sequence" else EPOCH)))
    usable = [k for k in existing(rows, keys) if staged is None or k in staged.columns]
    if staged is None or staged.isEmpty():
        alive = latest(rows, usable, column, mode).filter(~flag) if usable else rows.filter(~flag)
        return Load(alive, alive.count(), 0, 0, seen["watermark"])
    if not usable:
        return Load(staged.unionByName(rows, allowMissingColumns=True), seen["rows"], 0, 0, seen["watermark"])
    newest = settled(latest(rows, usable, column, mode))
    gone, alive = newest.filter(flag), newest.filter(~flag)
    left = remove_keys(staged, gone, usable) if mode == "soft_delete" else staged
    total, updated = alive.count(), count_matches(alive, staged, usable)
    return Load(upsert(left, alive, usable, config.get("overwrite_nulls", False)), total - updated, updated, seen["flagged"], seen["watermark"])
