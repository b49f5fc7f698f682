"""Sinks: staged Parquet, format conversion, Arrow files, event rows, webhooks."""

from __future__ import annotations

import json
import urllib.request
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import ConfigError, read_path

FORMATS = ("parquet", "arrow", "csv", "json", "orc")


def staging_uri(root: str, tenant_id: str, job_id: str, name: str = "data") -> str:
    return f"{root.rstrip('/')}/dpl-staging/{tenant_id}/{job_id}/{name}.parquet"


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite") -> str:
    df.write.mode(mode).option("compression", compression).parquet(path)
    return path


def write_arrow(df: DataFrame, path: str) -> str:
    """Arrow IPC bytes, one Parquet row ``(part, ipc)`` per record batch, so writing stays on the executors."""

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, b in enumerate(part):
            out = pa.BufferOutputStream()
            with pa.ipc.new_file(out, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["part", "ipc"])

    df.mapInArrow(work, "part int, ipc binary").write.mode("overwrite").parquet(path)
    return path


def read_arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of :func:`write_arrow`."""

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in part:
            for data in b.column(1).to_pylist():
                reader = pa.ipc.open_file(pa.BufferReader(data))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    return spark.read.parquet(path).select("part", "ipc").mapInArrow(work, schema)


def arrow_bytes(df: DataFrame) -> bytes:
    """A small table as one Arrow IPC file; it passes through the driver."""
    table = df.toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def write_format(df: DataFrame, path: str, kind: str, **options: str) -> str:
    if kind not in FORMATS:
        raise ConfigError(f"unknown format {kind!r}; there are {', '.join(FORMATS)}")
    if kind == "arrow":
        return write_arrow(df, path)
    writer = df.write.mode("overwrite").options(**options)
    if kind == "csv":
        writer = writer.option("header", "true")
    writer.format(kind).save(path)
    return path


def convert_format(spark: SparkSession, source: str, source_kind: str, target: str, target_kind: str) -> str:
    """Read one format, write another."""
    return write_format(read_path(spark, source, source_kind, {}), target, target_kind)


EVENTS = "event_id string, event_type string, payload string, at string"


def append_events(events: DataFrame, path: str) -> None:
    """Rows ``event_type, payload`` (JSON text) as events, written by the tasks that have them."""
    now = datetime.now(UTC).isoformat()
    events.select(F.expr("replace(uuid(), '-', '')").alias("event_id"), "event_type", "payload", F.lit(now).alias("at")).write.mode("append").parquet(path)


def append_event(spark: SparkSession, path: str, event_type: str, payload: dict) -> None:
    """One row of an event log."""
    row = (uuid.uuid4().hex, event_type, json.dumps(payload, sort_keys=True, default=str), datetime.now(UTC).isoformat())
    spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(path)


def post_webhook(url: str, payload: dict, timeout: int = 10) -> bool:
    """Whether the receiver answered under 400; failures never reach the job."""
    try:
        request = urllib.request.Request(url, json.dumps(payload, default=str).encode(), {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status < 400
    except Exception:  # noqa: BLE001 - a hook is best effort
        return False
