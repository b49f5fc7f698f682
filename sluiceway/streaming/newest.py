"""The newest row of each key over a stream: late rows, expiry, replay without doubles.

State per key is the newest row seen, by event time and then by a tie column; a row
that comes late and is older changes nothing.  A key whose newest row is ``keep``
behind the watermark is given up by an event-time timer.  What changes goes out as
*changes*: the new row, or the old one marked as expired.  Changes are written under
their batch's number, so a batch that runs again replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import col
from ..operators.incremental import latest
from ..plans.keyed_files import KeyedFiles
from ..sources.ordered_log import JSON_TIMES, drain

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "at bigint, tie bigint, row string"
CHANGES = "at bigint, tie bigint, row string, expired boolean"


class Newest(StatefulProcessor):
    """Holds ``(at, tie, row)`` of a key; ``keep_ms`` of 0 keeps keys for ever."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("newest", STATE)

    def _ends(self, at: int) -> int:
        return at // 1000 + self.keep_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        old = tuple(self.held.get()) if self.held.exists() else None
        best = old
        for frame in rows:
            for candidate in zip(frame["at"], frame["tie"], frame["row"], strict=True):
                if best is None or candidate[:2] > best[:2]:
                    best = (int(candidate[0]), int(candidate[1]), candidate[2])
        if best is not old and best is not None:
            self.held.update(best)
            if self.keep_ms:
                if old is not None:
                    self.handle.deleteTimer(self._ends(old[0]))
                self.handle.registerTimer(self._ends(best[0]))
            yield _change(best, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        if self.held.exists():
            row = tuple(self.held.get())
            self.held.clear()
            yield _change(row, True)

    def close(self) -> None:
        pass


def _change(row: tuple, expired: bool) -> pd.DataFrame:
    return pd.DataFrame({"at": [row[0]], "tie": [row[1]], "row": [row[2]], "expired": [expired]})


def newest_changes(events: DataFrame, keys: Sequence[str], time_col: str, tie_col: str, delay: str, keep: str | None = None) -> DataFrame:
    """A stream of changes of ``events``: ``at`` (microseconds), ``tie``, ``row`` (JSON of the event), ``expired``.

    ``delay`` is how far behind the newest event time the watermark stays, ``keep``
    how long a key lives after its newest row (None: for ever); rows without a
    time or with a null key column are kept under that key and time 0.
    """
    spark = events.sparkSession
    keep_ms = _millis(spark, keep)
    marked = events.withWatermark(time_col, delay)
    rows = marked.select(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)], col(time_col).alias("time"), F.coalesce(F.unix_micros(col(time_col).cast("timestamp")), F.lit(0)).alias("at"), F.coalesce(col(tie_col).cast("bigint"), F.lit(0)).alias("tie"), F.to_json(F.struct(*map(col, events.columns)), JSON_TIMES).alias("row"))
    return rows.groupBy(*[f"k{i}" for i in range(len(keys))]).transformWithStateInPandas(Newest(keep_ms), CHANGES, "Append", "EventTime")


def _millis(spark: SparkSession, span: str | None) -> int:
    if span is None:
        return 0
    at = F.lit("2001-01-01 00:00:00").cast("timestamp")
    return spark.range(1).select(((F.unix_micros(at + F.expr(f"INTERVAL {span}")) - F.unix_micros(at)) / 1000).cast("bigint")).first()[0]


def keep_newest(events: DataFrame, path: str, checkpoint: str, keys: Sequence[str], time_col: str, tie_col: str, delay: str = "0 seconds", keep: str | None = None) -> list[dict]:
    """Run all that is there of a stream through the state and write its changes under ``path/batch=<n>``; the batches' progress."""
    spark = events.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        changes = newest_changes(events, keys, time_col, tie_col, delay, keep)
        return drain(changes, checkpoint, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    finally:
        spark.conf.set(STORE, before)


def newest_rows(spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str]) -> DataFrame:
    """The table that a stream's changes come to: each key's newest row, without those that expired."""
    changes = spark.read.schema(CHANGES + ", batch bigint").parquet(path)
    rows = changes.select("at", "tie", "expired", "batch", F.from_json("row", schema, JSON_TIMES).alias("r"))
    by = rows.groupBy(*[F.col(f"r.{k}").alias(f"k{i}") for i, k in enumerate(keys)])
    # Of one row's changes the later batch, and in it the expiry, is what holds.
    last = by.agg(F.max_by(F.struct("expired", "r"), F.struct("at", "tie", "batch", "expired")).alias("last"))
    return last.filter("NOT last.expired").select("last.r.*")


def merge_stream(events: DataFrame, table: KeyedFiles, checkpoint: str, keys: Sequence[str], time_col: str, name: str, deleted: str | None = None, overwrite_nulls: bool = False) -> list[dict]:
    """Merge a stream's batches into a table of files: each folded to the newest row of a key, and committed once under its number.

    ``deleted`` is a condition on rows.  A batch that runs again after its commit
    finds itself there and does nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = latest(batch, keys, time_col)
        table.merge(rows, F.expr(deleted) if deleted else None, overwrite_nulls, source=f"{name}:{number}")

    return drain(events, checkpoint, step)
