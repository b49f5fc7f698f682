"""Dataset versions named by content: equal rows and schema give one version, in any order."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from .jobs import Records

VERSIONS = "version string, tenant_id string, dataset_uri string, metadata string, row_count bigint, committed_at string"


def content_hash(df: DataFrame) -> tuple[str, int]:
    """16 hexadecimal digits over schema, row count and two order-free sums of row hashes."""
    text = F.to_json(F.struct(*[col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(text, F.lit(s)).cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2)]
    row = df.agg(F.count("*").alias("n"), *sums).first()
    named = json.dumps([sorted(df.dtypes), row["n"], str(row["s1"]), str(row["s2"])])
    return hashlib.sha256(named.encode()).hexdigest()[:16], row["n"]


def commit_version(spark: SparkSession, root: str, uri: str, metadata: dict | None = None, tenant_id: str = "default") -> str:
    """Name the Parquet dataset at ``uri`` and record it."""
    version, rows = content_hash(spark.read.parquet(uri))
    Records(spark, root).append("versions", [{"version": version, "tenant_id": tenant_id, "dataset_uri": uri, "metadata": json.dumps(metadata or {}, sort_keys=True, default=str), "row_count": rows, "committed_at": datetime.now(UTC).isoformat()}], VERSIONS)
    return version


def get_version(spark: SparkSession, root: str, version: str, tenant_id: str = "default") -> dict:
    """The newest record of a version; an unknown one is an error."""
    rows = Records(spark, root).read("versions", VERSIONS).filter((F.col("version") == version) & (F.col("tenant_id") == tenant_id))
    found = rows.orderBy(F.desc("committed_at")).first()
    if found is None:
        raise KeyError(f"no version {version}")
    return found.asDict() | {"metadata": json.loads(found["metadata"])}
