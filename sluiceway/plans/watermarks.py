"""High watermarks per tenant and table, stored after the data they speak of."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import settled
from ..operators.incremental import EPOCH, MODES, Load, deleted_flag, delta, latest, load_delta, new_watermark
from .jobs import Records
from .keyed_files import KeyedFiles, Merge

STATE = "tenant_id string, table_name string, watermark string, saved_at string"


class Watermarks:
    """An append-only state table; a null watermark marks a reset."""

    def __init__(self, spark: SparkSession, root: str):
        self.records = Records(spark, root)

    def get(self, table: str, tenant_id: str = "default") -> str:
        rows = self.records.read("watermarks", STATE).filter((F.col("tenant_id") == tenant_id) & (F.col("table_name") == table))
        last = rows.orderBy(F.desc("saved_at")).first()
        return (last["watermark"] if last else None) or EPOCH

    def save(self, table: str, watermark: str | None, tenant_id: str = "default") -> None:
        self.records.append("watermarks", [{"tenant_id": tenant_id, "table_name": table, "watermark": watermark, "saved_at": datetime.now(UTC).isoformat()}], STATE)

    def reset(self, table: str, tenant_id: str = "default") -> None:
        self.save(table, None, tenant_id)


def run_load(spark: SparkSession, root: str, source: DataFrame, staged: DataFrame | None, config: dict, output: str, tenant_id: str = "default") -> Load:
    """Load the delta, write the merged table to a new path, and only then move the watermark."""
    marks, table = Watermarks(spark, root), config.get("table_name", "unknown_table")
    load = load_delta(source, staged, config, marks.get(table, tenant_id))
    load.dataframe.write.mode("errorifexists").parquet(output)
    if load.inserted_rows or load.updated_rows or load.deleted_rows:
        marks.save(table, load.watermark, tenant_id)
    return load


def merge_load(spark: SparkSession, root: str, source: DataFrame, table: KeyedFiles, config: dict, tenant_id: str = "default") -> tuple[Merge, str]:
    """Merge what is above the watermark into a table of files, and only then move the watermark; the merge and the new mark.

    Config as for a delta load; keys are the table's own.  The delta is folded to
    the newest row of a key, and one that ran before finds its commit and changes
    nothing.
    """
    marks, name = Watermarks(spark, root), config.get("table_name", "unknown_table")
    mode = config.get("cdc_mode", "timestamp")
    mode = mode if mode in MODES else "sequence"
    column, before = config.get("watermark_column", "updated_at"), marks.get(name, tenant_id)
    rows = settled(delta(source, column, before, mode, config.get("allowed_lateness")))
    reached = new_watermark(rows, column, mode, F.count("*").alias("rows")).first()
    if not reached["rows"]:
        return table.merge(rows), before
    flag = deleted_flag(rows, config.get("soft_delete_column", "is_deleted")) if mode == "soft_delete" else None
    newest = latest(rows, table.state()["keys"], column, mode)
    done = table.merge(newest, flag, config.get("overwrite_nulls", False), source=f"{tenant_id}:{name}:{before}:{reached['watermark']}:{reached['rows']}")
    marks.save(name, reached["watermark"], tenant_id)
    return done, reached["watermark"]
