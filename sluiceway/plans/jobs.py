"""Job, profile and check records in Parquet tables, and the dashboard over them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col, is_orderless, unused

JOBS = "job_id string, tenant_id string, job_type string, status string, source_config string, destination_config string, row_count bigint, column_count bigint, quality_score decimal(5,4), data_version string, output_uri string, error_message string, created_at string, updated_at string"
STATUSES = ("pending", "running", "completed", "failed", "cancelled")
TYPES = ("ingest", "profile", "clean", "transform", "orchestrate")


class Records:
    """Append-only tables under one folder; the newest row of a key is its state."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, table: str, rows: list[dict], schema: str) -> None:
        names = [c.split()[0] for c in schema.replace("decimal(5,4)", "decimal").split(", ")]
        data = [tuple(r.get(n) for n in names) for r in rows]
        self.spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except Exception as problem:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], schema)

    def job(self, tenant_id: str, job_type: str, source: dict | None = None, destination: dict | None = None, job_id: str | None = None, **state) -> str:
        """Create a job, or add a newer state of one."""
        from decimal import Decimal

        from ..sources.readers import redacted

        now = datetime.now(UTC).isoformat()
        job_id = job_id or uuid.uuid4().hex
        if state.get("quality_score") is not None:
            state["quality_score"] = Decimal(str(round(state["quality_score"], 4)))
        row = {"job_id": job_id, "tenant_id": tenant_id, "job_type": job_type, "status": "pending", "source_config": json.dumps(redacted(source or {}), default=str), "destination_config": json.dumps(redacted(destination or {}), default=str), "created_at": now, "updated_at": now} | state
        self.append("pipeline_jobs", [row], JOBS)
        return job_id

    def jobs(self, tenant_id: str) -> DataFrame:
        return current(self.read("pipeline_jobs", JOBS).filter(F.col("tenant_id") == tenant_id), ["job_id"], "updated_at")

    def find(self, tenant_id: str, job_id: str) -> dict | None:
        row = self.jobs(tenant_id).filter(F.col("job_id") == job_id).first()
        return row.asDict() if row else None


def current(table: DataFrame, keys: list[str], at: str, ties: Sequence[Column] | None = None) -> DataFrame:
    """The newest row of each key; ties go by ``ties``, or else by the other columns, so reruns agree."""
    kinds = {f.name: f.dataType for f in table.schema}
    rest = [col(c) for c in table.columns if c not in (*keys, at) and not is_orderless(kinds[c])] if ties is None else ties
    place = F.row_number().over(Window.partitionBy(*map(col, keys)).orderBy(col(at).desc(), *rest))
    n = unused(table, "place")
    return table.withColumn(n, place).filter(F.col(n) == 1).drop(n)


def dashboard(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """One row over the newest ``limit`` jobs: counts by status, average quality, rows, failing source types."""
    recent = jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    failing = F.sort_array(F.collect_set(F.when(F.col("status") == "failed", F.get_json_object("source_config", "$.type"))))
    return recent.agg(F.count("*").alias("jobs"), *counts, F.round(F.avg(F.col("quality_score").cast("double")), 4).alias("avg_quality"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"), F.slice(failing, 1, 5).alias("failing_sources"))


def versions(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Versions of all jobs, or of those among the newest ``limit`` jobs."""
    seen = jobs.orderBy(F.desc("created_at"), "job_id").limit(limit) if limit is not None else jobs
    return seen.filter("data_version is not null").select("data_version", "job_id", "output_uri", "row_count", "created_at")
