"""Micro-batches from streams: decode JSON, stage exactly once, windows over event time."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_MESSAGES = 100_000
MAX_SECONDS = 300


def kafka_options(config: dict) -> dict[str, str]:
    """Options of Spark's Kafka source; SASL over TLS where both credentials are given."""
    out = {
        "kafka.bootstrap.servers": config["bootstrap_servers"],
        "subscribe": config["topic"],
        "startingOffsets": config.get("auto_offset_reset", "earliest"),
        "maxOffsetsPerTrigger": str(config.get("batch_size", 1000)),
        "failOnDataLoss": "true",
    }
    if config.get("group_id"):
        out["kafka.group.id"] = config["group_id"]
    if config.get("username") and config.get("password"):
        login = f'org.apache.kafka.common.security.plain.PlainLoginModule required username="{config["username"]}" password="{config["password"]}";'
        out |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": login}
    return out


def read_kafka(spark: SparkSession, config: dict) -> DataFrame:
    """The messages' values as text; needs Spark's Kafka package."""
    return spark.readStream.format("kafka").options(**kafka_options(config)).load().select(F.col("value").cast("string").alias("value"))


def decode_json(messages: DataFrame, schema: str, column: str = "value", options: dict[str, str] | None = None) -> DataFrame:
    """Fields of JSON objects; other JSON values as ``value``; ``is_valid`` false for what is no JSON.

    Works on batch and streaming frames alike.  ``options`` are those of Spark's
    JSON reader: its own format of times keeps milliseconds only.
    """
    text = F.trim(F.col(column))
    parsed = F.try_parse_json(text)
    record = F.from_json(text, schema, options or {})
    is_object = text.startswith("{")
    names = [c.split()[0] for c in schema.split(",")]
    fields = [F.when(is_object, record[n]).alias(n) for n in names]
    rest = [c for c in messages.columns if c != column]
    return messages.select(*rest, *fields, F.when(~is_object, text).alias("scalar_value"), parsed.isNotNull().alias("is_valid"))


def stage_stream(stream: DataFrame, path: str, checkpoint: str, timeout_seconds: int = 30, once: bool = True, partition_by: list[str] | None = None, stop_after: int | None = None) -> dict:
    """Write what is available to Parquet and stop; a restart goes on where the checkpoint ends.

    With ``stop_after`` no further batch begins once that many rows are written;
    its source should cap what a batch reads.  ``finished`` means that nothing was
    left or the limit was reached, not the time.

    Offsets are committed after the files, so a crash neither loses nor doubles rows.
    """
    if not 0 < timeout_seconds <= MAX_SECONDS:
        raise ValueError(f"timeout must be between 1 and {MAX_SECONDS} seconds")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
    ends, finished = time.monotonic() + timeout_seconds, False
    while not finished and time.monotonic() < ends:
        if stop_after is not None and sum(int(p["numInputRows"]) for p in query.recentProgress) >= stop_after:
            finished = True
            query.stop()
            break
        finished = query.awaitTermination(min(0.2, max(0.0, ends - time.monotonic())) if stop_after is not None else timeout_seconds)
    if not finished:
        query.stop()
    if query.exception():
        raise query.exception()
    rows = sum(int(p["numInputRows"]) for p in query.recentProgress)
    return {"output_uri": path, "message_count": rows, "schema": dict(stream.dtypes), "finished": bool(finished)}


def ingest_stream_batch(spark: SparkSession, config: dict, stream: DataFrame | None = None) -> dict:
    """Kafka to staged Parquet: ``topic, bootstrap_servers, schema, output_path, checkpoint``; ``stream`` may stand in."""
    size = int(config.get("batch_size", 1000))
    if not 0 < size <= MAX_MESSAGES:
        raise ValueError(f"batch_size must be between 1 and {MAX_MESSAGES}")
    rows = stream if stream is not None else read_kafka(spark, config)
    if config.get("schema"):
        rows = decode_json(rows, config["schema"], options=config.get("json_options"))
    return stage_stream(rows, config["output_path"], config["checkpoint"], int(config.get("timeout_seconds", 30)), stop_after=size) | {"topic": config.get("topic")}


def tumbling(events: DataFrame, time_col: str, size: str, keys: list[str], value_col: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum by tumbling (or, with ``slide``, sliding) window and keys; ``late`` sets the watermark of streams."""
    if late:
        events = events.withWatermark(time_col, late)
    window = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, time_col: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions of each key that end after ``gap`` without an event."""
    if late:
        events = events.withWatermark(time_col, late)
    out = events.groupBy(F.session_window(time_col, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def deduplicated(events: DataFrame, time_col: str, keys: list[str], late: str) -> DataFrame:
    """A stream without repeats of ``keys`` inside the watermark."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def stream_reservoir(events: DataFrame, n: int, keys: list[str], path: str, checkpoint: str, seed: int = 42) -> int:
    """A uniform sample of ``n`` rows of a stream so far: the first n by hash, under ``path/v<batch>``; the current batch's number (-1 before any).

    A batch read again after a failure writes the same folder anew.  A last
    reservoir that can't be read stops the stream.
    """
    from ..operators.sample import random_sample

    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        if number > 0:
            batch = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}"))
        random_sample(batch, n, keys, seed).write.mode("overwrite").parquet(f"{path}/v{number}")

    run = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return max((int(p["batchId"]) for p in run.recentProgress if p["numInputRows"]), default=-1)
