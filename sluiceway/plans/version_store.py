"""Versions of a dataset as trees of hashes over chunks of its rows.

Rows go into chunks by a hash of their key, so equal rows are in equal chunks however
the files were cut.  A chunk's hash is over its rows in any order; a node's hash is
over its chunks, the root's over the nodes and the schema.  Hence

* equal datasets are one version, and its name is the root's hash;
* a chunk is stored once, by its hash, and shared by all versions that have it;
* a difference compares nodes, then chunks under unequal nodes, and reads rows of
  unequal chunks only.

Layout: ``objects/<batch>/_chunk=<n>`` rows, ``index`` which batch has a chunk's hash,
``trees/<version>`` chunks and nodes, ``versions`` one row per commit, appended last.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col, existing
from ..functions.tables import settled
from .jobs import Records

#: Chunks under a node.
FAN = 64
VERSIONS = "version string, tenant_id string, keys array<string>, chunks int, fields string, row_count bigint, stored_rows bigint, metadata string, committed_at string"
INDEX = "chunk int, hash string, batch string"


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """Of a row's JSON, columns in order of names, nulls included."""
    text = F.to_json(F.struct(*[col(c) for c in sorted(columns)]), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    return F.xxhash64(text, F.lit(seed)).cast("decimal(38,0)")


class VersionStore:
    """Versions under one root; ``keys`` of a commit name a row, and unknown ones are left out."""

    def __init__(self, spark: SparkSession, root: str, tenant_id: str = "default", rows_per_chunk: int = 1_000_000):
        self.spark, self.root, self.tenant, self.rows_per_chunk = spark, root.rstrip("/"), tenant_id, rows_per_chunk
        self.records = Records(spark, self.root)

    def list(self) -> DataFrame:
        """Every commit of the tenant, newest first: all there are, unless limited by the caller."""
        mine = self.records.read("versions", VERSIONS).filter(F.col("tenant_id") == self.tenant)
        return mine.select("version", "row_count", "stored_rows", "metadata", "committed_at").orderBy(F.desc("committed_at"))

    def get(self, version: str) -> dict:
        """The newest commit of a version; an unknown one is an error."""
        found = self.records.read("versions", VERSIONS).filter((F.col("version") == version) & (F.col("tenant_id") == self.tenant)).orderBy(F.desc("committed_at")).first()
        if found is None:
            raise KeyError(f"no version {version}")
        return found.asDict()

    def _chunk_count(self, rows: int) -> int:
        """As many for all versions of the store, or their chunks couldn't be shared."""
        first = self.records.read("versions", VERSIONS).orderBy("committed_at").first()
        return first["chunks"] if first else 1 << max(0, math.ceil(math.log2(max(1, rows / self.rows_per_chunk))))

    def commit(self, df: DataFrame, keys: Sequence[str], metadata: dict | None = None) -> str:
        """Store what is new of ``df`` and name the version."""
        names = existing(df, keys) or df.columns
        df = settled(df)
        count = df.count()
        chunks = self._chunk_count(count)
        rows = df.select(F.pmod(F.xxhash64(*map(col, names)), F.lit(chunks)).cast("int").alias("_chunk"), F.struct(*map(col, df.columns)).alias("row"), *[row_hash(df.columns, s).alias(f"h{s}") for s in (1, 2)])
        schema = json.dumps(sorted(df.dtypes))
        sums = rows.groupBy(F.col("_chunk").alias("chunk")).agg(F.count("*").alias("rows"), F.sum("h1").alias("a"), F.sum("h2").alias("b"))
        made = settled(sums.select("chunk", "rows", F.sha2(F.concat_ws(":", F.lit(schema), F.col("rows").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("hash")))
        nodes = made.groupBy(F.floor(F.col("chunk") / FAN).cast("int").alias("node")).agg(F.sha2(_listed(F.struct("chunk", "hash")), 256).alias("hash"), F.sum("rows").alias("rows"))
        nodes = settled(nodes)
        version = nodes.agg(F.sha2(F.concat(F.lit(f"{schema}:{chunks};"), _listed(F.struct("node", "hash"))), 256).alias("v")).first()["v"][:16]
        stored = 0
        if self.spark.createDataFrame([(version,)], "version string").join(self.records.read("versions", VERSIONS), "version", "left_semi").isEmpty():
            stored = self._store(rows, made)
            tree = f"{self.root}/trees/{version}"
            placed = made.join(self.records.read("index", INDEX).groupBy("chunk", "hash").agg(F.min("batch").alias("batch")), ["chunk", "hash"], "left")
            placed.withColumn("node", F.floor(F.col("chunk") / FAN).cast("int")).write.mode("overwrite").parquet(f"{tree}/chunks")
            nodes.write.mode("overwrite").parquet(f"{tree}/nodes")
        self.records.append("versions", [{"version": version, "tenant_id": self.tenant, "keys": list(names), "chunks": chunks, "fields": json.dumps(df.schema.jsonValue()), "row_count": count, "stored_rows": stored, "metadata": json.dumps(metadata or {}, sort_keys=True, default=str), "committed_at": datetime.now(UTC).isoformat()}], VERSIONS)
        return version

    def _store(self, rows: DataFrame, made: DataFrame) -> int:
        """Write the chunks that no version has yet; how many rows they have."""
        new = settled(made.join(self.records.read("index", INDEX), ["chunk", "hash"], "left_anti"))
        batch = uuid.uuid4().hex
        fresh = rows.join(new.select(F.col("chunk").alias("_chunk")), "_chunk", "left_semi").select("_chunk", "row")
        fresh.repartition("_chunk").sortWithinPartitions("_chunk").write.partitionBy("_chunk").parquet(f"{self.root}/objects/{batch}")
        new.select("chunk", "hash", F.lit(batch).alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.root}/index")
        return new.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def chunks(self, version: str) -> DataFrame:
        """``node, chunk, hash, rows, batch`` of a version."""
        self.get(version)
        return self.spark.read.schema("chunk int, hash string, rows bigint, batch string, node int").parquet(f"{self.root}/trees/{version}/chunks")

    def nodes(self, version: str) -> DataFrame:
        self.get(version)
        return self.spark.read.schema("node int, hash string, rows bigint").parquet(f"{self.root}/trees/{version}/nodes")

    def _rows(self, version: str, chunks: DataFrame) -> DataFrame:
        """Rows of some of a version's chunks, read from their own files."""
        schema = T.StructType.fromJson(json.loads(self.get(version)["fields"]))
        at = [f"{self.root}/objects/{r['batch']}/_chunk={r['chunk']}" for r in chunks.select("batch", "chunk").collect()]
        if not at:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(T.StructType([T.StructField("row", schema)])).parquet(*at).select("row.*")

    def restore(self, version: str) -> DataFrame:
        """The rows of a version."""
        return self._rows(version, self.chunks(version))

    def unequal(self, old: str, new: str) -> DataFrame:
        """``chunk, old_batch, new_batch`` of chunks that differ; those under equal nodes aren't looked at."""
        a, b = self.nodes(old).select("node", F.col("hash").alias("x")), self.nodes(new).select("node", F.col("hash").alias("y"))
        nodes = a.join(b, "node", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select("node")
        side = lambda v, h, c: self.chunks(v).join(nodes, "node", "left_semi").select("chunk", F.col("hash").alias(h), F.col("batch").alias(c))
        both = side(old, "x", "old_batch").join(side(new, "y", "new_batch"), "chunk", "full_outer")
        return both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("chunk", "old_batch", "new_batch")

    def diff(self, old: str, new: str) -> DataFrame:
        """``change`` (added, removed, changed), ``old`` and ``new`` row of each key that differs.

        Columns that only one version has are null in the other.  Versions of
        different chunk counts are compared as a whole.
        """
        a, b = self.get(old), self.get(new)
        keys = a["keys"] if a["keys"] == b["keys"] else sorted(set(a["keys"]) & set(b["keys"]))
        if a["chunks"] == b["chunks"]:
            apart = settled(self.unequal(old, new))
            x = self._rows(old, apart.filter("old_batch IS NOT NULL").select("chunk", F.col("old_batch").alias("batch")))
            y = self._rows(new, apart.filter("new_batch IS NOT NULL").select("chunk", F.col("new_batch").alias("batch")))
        else:
            x, y = self.restore(old), self.restore(new)
        names = list(dict.fromkeys([*x.columns, *y.columns]))
        whole = lambda df, other: F.struct(*[(col(c) if c in df.columns else F.lit(None).cast(other.schema[c].dataType)).alias(c) for c in names])
        x, y = x.select(whole(x, y).alias("old")), y.select(whole(y, x).alias("new"))
        same = F.lit(True)
        for k in keys:
            same &= F.col("old")[k].eqNullSafe(F.col("new")[k])
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
        return x.join(y, same, "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))).select(change.alias("change"), "old", "new")


def _listed(item: Column) -> Column:
    """Structs of two fields as one text, in order."""
    pairs = F.sort_array(F.collect_list(item))
    return F.array_join(F.transform(pairs, lambda p: F.to_json(p)), ";")
