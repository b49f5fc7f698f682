"""Tables written once and read many times."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines see: the session's ``spark.checkpoint.dir``.

    A local session without one takes a temporary folder; on a cluster that is an
    error, as other machines couldn't read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="spark-tables-")
    return os.path.join(folder, f"{name}-{uuid.uuid4().hex}")


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that several passes don't repeat what leads to it.

    Lost executors only read again.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
