"""An ordered log as files, and a stream source over it with offsets.

A log is a folder: ``data/<batch>`` holds rows with consecutive offsets in files
sorted by them, ``index`` one row per file with its offsets, appended after the data,
so a reader never sees half a batch.  The source gives ``offset, value`` like a
message queue: it starts at the earliest or latest offset or at a given one, goes on
where its query's checkpoint ends, takes at most so many rows a batch, and reads each
file's part of a batch in a task of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.columns import col, unused
from ..operators.sample import with_row_id

INDEX = "file string, first bigint, last bigint"
SCHEMA = "offset bigint, value string"
#: How times stand in messages: with all their digits, and with a zone where they have one.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def append_log(df: DataFrame, path: str, order_by: Sequence[str], per_file: int = 1_000_000) -> int:
    """Append rows as JSON messages in the order of columns, which must be total; the log's end."""
    spark, path = df.sparkSession, path.rstrip("/")
    start = log_end(spark, path)
    at = unused(df, "offset")
    numbered = with_row_id(df, order_by, at)
    rows = numbered.select((F.col(at) + start).alias("offset"), F.to_json(F.struct(*map(col, df.columns)), JSON_TIMES).alias("value"))
    n = df.count()
    if not n:
        return start
    data = f"{path}/data/{uuid.uuid4().hex}"
    rows.repartitionByRange(max(1, -(-n // per_file)), "offset").sortWithinPartitions("offset").write.parquet(data)
    stored = spark.read.schema(SCHEMA).parquet(data).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    stored.coalesce(1).write.mode("append").parquet(f"{path}/index")
    return start + n


def read_index(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index")
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], INDEX)


def log_end(spark: SparkSession, path: str) -> int:
    """The offset that the next message gets."""
    return read_index(spark, path).agg(F.coalesce(F.max("last") + 1, F.lit(0))).first()[0]


def read_log(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """The messages from ``start`` up to ``end``, as a table."""
    files = [r["file"] for r in read_index(spark, path).filter((F.col("last") >= start) & (F.lit(True) if end is None else F.col("first") < end)).collect()]
    rows = spark.read.schema(SCHEMA).parquet(*files) if files else spark.createDataFrame([], SCHEMA)
    return rows.filter((F.col("offset") >= start) & (F.lit(True) if end is None else F.col("offset") < end))


class Slice(InputPartition):
    """A file's messages from one offset up to another."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class LogReader(DataSourceStreamReader):
    """Options: ``path, starting`` (earliest, latest or a number), ``max_rows`` a batch (0: all), ``position`` (where the checkpoint ends)."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.starting, self.most = options.get("starting", "earliest"), int(options.get("max_rows", 0))
        self.at = int(options["position"]) if options.get("position") else None

    def _index(self) -> list[tuple[str, int, int]]:
        """Files and their offsets; the folder may be in any store that Arrow knows."""
        from pyarrow import dataset, fs

        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        if store.get_file_info(f"{root}/index").type == fs.FileType.NotFound:
            return []
        rows = dataset.dataset(f"{root}/index", format="parquet", filesystem=store).to_table().to_pydict()
        return sorted(zip(rows["file"], rows["first"], rows["last"], strict=True), key=lambda r: r[1])

    def initialOffset(self) -> dict:  # noqa: N802
        index = self._index()
        if self.starting == "earliest":
            return {"offset": index[0][1] if index else 0}
        if self.starting == "latest":
            return {"offset": index[-1][2] + 1 if index else 0}
        return {"offset": int(self.starting)}

    def latestOffset(self) -> dict:  # noqa: N802
        index = self._index()
        if self.at is None:
            self.at = self.initialOffset()["offset"]
        end = max(self.at, index[-1][2] + 1 if index else 0)
        return {"offset": min(end, self.at + self.most) if self.most else end}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        low, high = start["offset"], end["offset"]
        self.at = max(self.at or 0, high)
        return [Slice(file, max(low, first), min(high, last + 1)) for file, first, last in self._index() if last >= low and first < high]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset, fs

        store, file = fs.FileSystem.from_uri(partition.file)
        at = dataset.field("offset")
        rows = dataset.dataset(file, format="parquet", filesystem=store)
        yield from rows.to_batches(columns=["offset", "value"], filter=(at >= partition.start) & (at < partition.end))


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sluiceway_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:  # noqa: N802
        return LogReader(self.options)


def committed(spark: SparkSession, checkpoint: str) -> int | None:
    """The offset up to which a query with this checkpoint has finished; None before its first batch."""
    try:
        done = {int(r["n"]) for r in spark.read.text(f"{checkpoint}/commits").select(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)$", 1).alias("n")).filter("n <> ''").collect()}
        logged = spark.read.text(f"{checkpoint}/offsets", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)$", 1).alias("n"), "value").filter("n <> ''").collect()
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return None
    ends = {int(r["n"]): r["value"].splitlines()[-1] for r in logged}
    finished = [n for n in done if n in ends]
    return json.loads(ends[max(finished)])["offset"] if finished else None


def stream_log(spark: SparkSession, path: str, checkpoint: str, starting: str | int = "earliest", max_rows: int = 0) -> DataFrame:
    """The log as a stream for a query with this checkpoint."""
    spark.dataSource.register(LogSource)
    source = spark.readStream.format("sluiceway_log").option("path", path).option("starting", str(starting)).option("max_rows", str(max_rows))
    if (position := committed(spark, checkpoint)) is not None:
        source = source.option("position", str(position))
    return source.load()


def drain(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], mode: str = "append") -> list[dict]:
    """Hand all that is there to ``work(batch, number)``, batch after batch, and stop; the batches' progress.

    A batch that broke off comes again with its number: ``work`` must do it over
    rather than once more.
    """
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(work).start()
    try:
        query.processAllAvailable()
        return [json.loads(p.json) if not isinstance(p, dict) else p for p in query.recentProgress]
    finally:
        query.stop()
