"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of the contracts: space and the five ASCII control blanks.
BLANKS = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session that names none (tests, a laptop) gets a temporary folder;
    on a cluster other machines couldn't read it, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
    if not (current := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluiceway-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


#: While a table is written, what passes to and from Python workers goes in smaller batches.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _BATCHES}
    try:
        for k, v in _BATCHES.items():
            spark.conf.set(k, v)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it: a column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """A string column as ``str``; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, width: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pack tuples into record batches of bounded row count and (bytes values) bounded width."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str))) + sum(x.nbytes for x in row if isinstance(x, np.ndarray))
        if len(held) >= size or weight >= width:
            yield pack(held, schema)
            held, weight = [], 0
    if held:
        yield pack(held, schema)
    del held
    release()


def release() -> None:
    """Give memory that a task is done with back to the system: Python workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
