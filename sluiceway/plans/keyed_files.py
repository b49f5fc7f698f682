"""A keyed table of Parquet files whose merges rewrite only the files that a delta touches.

Layout under the table's root::

    data/<batch>/part-*.parquet      rows, never changed once written
    log/<version>/                   files added and removed, with rows and key range
    filters/<batch>/                 one row per file and block: a membership bitmap of keys
    commits/                         one row per version, appended last

A version exists once its row is in ``commits``; whatever a broken merge left behind
is not looked at, so readers see the old version or the new one.  Earlier versions
stay readable.  One writer at a time.

Which files a delta touches is found in two steps, without pairs of keys and files.
*Ranges*: keys and the files' bounds are numbered in one order; a file's bounds give
the ranks of the delta's keys between them, so a file without any is left alone.
*Bitmaps*: where only few keys lie in a file's range, they are looked up in its
bitmap (three bits in one block of 32 768), and it is left alone if none may be
there.  A bitmap never misses a key, so what is left alone holds none of them.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import col
from ..functions.tables import settled
from ..operators.incremental import count_matches, remove_keys, upsert
from ..operators.sample import with_row_id
from .jobs import Records

COMMITS = "version bigint, base bigint, keys array<string>, blocks int, fields string, rows bigint, source string, committed_at string"
#: Bits of a block, as Spark's bitmap functions have it.
BLOCK = 32_768
BITS_PER_KEY = 16
#: With more keys than this in its range, a file is taken as touched without looking at its bitmap.
FEW = 2_000
#: Versions whose logs are read together; then one lists all files again.
CHAIN = 20
#: Ranks of keys that share a join key.
RANKS = 4_096


@dataclass
class Merge:
    version: int
    inserted_rows: int
    updated_rows: int
    deleted_rows: int
    files_rewritten: int
    files_kept: int
    files_written: int


class KeyedFiles:
    """One table; ``keys`` name a row, nulls in them are equal."""

    def __init__(self, spark: SparkSession, root: str, rows_per_file: int = 1_000_000):
        self.spark, self.root, self.rows_per_file = spark, root.rstrip("/"), rows_per_file
        self.records = Records(spark, self.root)

    # --- versions ------------------------------------------------------------

    def commits(self) -> DataFrame:
        return self.records.read("commits", COMMITS)

    def state(self, version: int | None = None) -> dict:
        """The commit of a version, the newest by default; an unknown one is an error."""
        seen = self.commits() if version is None else self.commits().filter(F.col("version") == version)
        row = seen.orderBy(F.desc("version"), "committed_at").first()
        if row is None:
            raise KeyError(f"no version {version if version is not None else ''} of {self.root}")
        return row.asDict()

    def _chain(self, version: int) -> list[int]:
        """The version and all it was made from; versions that never were committed have no row."""
        base = {r["version"]: r["base"] for r in self.commits().select("version", "base").collect()}
        chain = [version]
        while base[chain[-1]] is not None:
            chain.append(base[chain[-1]])
        return chain

    def files(self, version: int | None = None) -> DataFrame:
        """``file, batch, rows, low, high`` of a version."""
        at = self.state(version)
        log = self.spark.read.schema(self._log_schema(at)).parquet(*[f"{self.root}/log/{v}" for v in self._chain(at["version"])])
        gone = log.filter("action = 'remove'").select("file")
        return log.filter("action = 'add'").join(gone, "file", "left_anti").select("file", "batch", "rows", "low", "high")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        at = self.state(version)
        return self._rows(at, [r["file"] for r in self.files(at["version"]).select("file").collect()])

    def _rows(self, at: dict, files: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(at["fields"]))
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _log_schema(self, at: dict) -> T.StructType:
        fields = T.StructType.fromJson(json.loads(at["fields"]))
        key = T.StructType([T.StructField(f"k{i}", fields[k].dataType) for i, k in enumerate(at["keys"])])
        return T.StructType([T.StructField("action", T.StringType()), T.StructField("file", T.StringType()), T.StructField("batch", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("low", key), T.StructField("high", key)])

    # --- writing -------------------------------------------------------------

    def create(self, df: DataFrame, keys: Sequence[str]) -> int:
        """The first version, or a whole new one: rows dealt out by ranges of keys."""
        blocks = max(1, math.ceil(self.rows_per_file * BITS_PER_KEY / BLOCK))
        known = [r[0] for r in self.commits().agg(F.max("version")).collect() if r[0] is not None]
        at = {"version": (known or [-1])[0] + 1, "base": None, "keys": list(keys), "blocks": blocks, "fields": json.dumps(df.schema.jsonValue())}
        self._commit(at, self._write(df, at), None)
        return at["version"]

    def _write(self, rows: DataFrame, at: dict) -> str:
        """Write rows as a new batch with its bitmaps; the batch's name."""
        batch = uuid.uuid4().hex
        path = f"{self.root}/data/{batch}"
        rows = settled(rows)
        n = rows.count()
        if n:
            parts = max(1, math.ceil(n / self.rows_per_file))
            keys = [col(k) for k in at["keys"]]
            (rows.repartitionByRange(parts, *keys) if parts > 1 else rows.coalesce(1)).sortWithinPartitions(*keys).write.parquet(path)
            spots = self._spots(self._stored(at, batch).select("file", "key"), at["blocks"])
            bits = spots.withColumn("bit", F.explode("bits")).groupBy("file", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
            bits.write.parquet(f"{self.root}/filters/{batch}")
        return batch if n else ""

    def _stored(self, at: dict, batch: str) -> DataFrame:
        """``file, key`` of a batch's rows."""
        schema = T.StructType.fromJson(json.loads(at["fields"]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/data/{batch}").select(F.col("_metadata.file_path").alias("file"), self._key(at).alias("key"))

    def _key(self, at: dict) -> Column:
        return F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(at["keys"])])

    @staticmethod
    def _spots(keys: DataFrame, blocks: int) -> DataFrame:
        """``keys`` with the block and the three bits of ``key``."""
        place = F.xxhash64("key", F.lit(1))
        bits = F.array(*[F.pmod(F.shiftright(place, 15 * i), F.lit(BLOCK)) for i in range(3)])
        return keys.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("bits", bits)

    def _commit(self, at: dict, batch: str, removed: DataFrame | None) -> int:
        """Log the files added and removed, then the commit; how many files were added."""
        added = self.spark.createDataFrame([], self._log_schema(at))
        if batch:
            found = self._stored(at, batch).groupBy("file").agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
            added = found.select(F.lit("add").alias("action"), "file", F.lit(batch).alias("batch"), "rows", "low", "high")
        log = added
        if at["base"] is not None and len(self._chain(at["base"])) >= CHAIN:
            # The log begins anew with all files that stay.
            kept = self.files(at["base"]).join(removed.select("file"), "file", "left_anti")
            log, at = added.unionByName(kept.withColumn("action", F.lit("add"))), at | {"base": None}
        elif removed is not None:
            log = added.unionByName(removed.select(F.lit("remove").alias("action"), "file"), allowMissingColumns=True)
        path = f"{self.root}/log/{at['version']}"
        # A merge that broke off before its commit may have left a log under this number.
        log.coalesce(1).write.mode("overwrite").parquet(path)
        counts = added.count()
        total = self._live_rows(at)
        self.records.append("commits", [at | {"rows": total, "committed_at": datetime.now(UTC).isoformat()}], COMMITS)
        return counts

    def _live_rows(self, at: dict) -> int:
        """Rows of the version that is about to be committed."""
        read = lambda v: self.spark.read.schema(self._log_schema(at)).parquet(f"{self.root}/log/{v}")
        old = self.state(at["base"])["rows"] if at["base"] is not None else 0
        mine = read(at["version"])
        gone = 0
        if at["base"] is not None:
            gone = self.files(at["base"]).join(mine.filter("action = 'remove'").select("file"), "file", "left_semi").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return old - gone + mine.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    # --- merging -------------------------------------------------------------

    def touched(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """``file, batch``: the files of a version that may hold one of ``keys`` (their columns named as the table's)."""
        at = self.state(version)
        files = settled(self.files(at["version"]))
        wanted = settled(keys.select(self._key(at).alias("key")).distinct())
        ranged = settled(self._ranks(wanted, files).filter("upto > before"))
        many = ranged.filter(F.col("upto") - F.col("before") > FEW).select("file", "batch")
        few = ranged.filter(F.col("upto") - F.col("before") <= FEW)
        batches = [r["batch"] for r in few.select("batch").distinct().collect()]
        if not batches:
            return many
        bitmaps = self.spark.read.schema("file string, block int, bitmap binary").parquet(*[f"{self.root}/filters/{b}" for b in batches])
        ranked = self._spots(with_row_id(wanted, ["key"], "rank"), at["blocks"]).withColumn("shelf", F.floor(F.col("rank") / RANKS))
        shelves = few.withColumn("shelf", F.explode(F.sequence(F.floor(F.col("before") / RANKS), F.floor((F.col("upto") - 1) / RANKS))))
        near = shelves.join(ranked, "shelf").filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
        byte = lambda bit: F.conv(F.hex(F.substring("bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        there = F.forall("bits", lambda bit: F.call_function("shiftright", byte(bit), (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
        hit = near.select("file", "batch", "block", "bits").join(bitmaps, ["file", "block"]).filter(there)
        return many.unionByName(hit.select("file", "batch").distinct())

    @staticmethod
    def _ranks(wanted: DataFrame, files: DataFrame) -> DataFrame:
        """``files`` with the ranks of keys in their range: from ``before`` up to ``upto`` less one."""
        low = files.select(F.col("low").alias("key"), F.lit(0).alias("kind"), "file")
        high = files.select(F.col("high").alias("key"), F.lit(2).alias("kind"), "file")
        bounds = low.unionByName(high)
        order = ["key", "kind", "file"]
        everything = bounds.unionByName(wanted.select("key", F.lit(1).alias("kind"), F.lit("").alias("file")))
        place = with_row_id(everything, order, "place").filter("kind <> 1").select("file", "kind", "place")
        among = with_row_id(bounds, order, "among").select("file", "kind", "among")
        keys_before = place.join(among, ["file", "kind"]).withColumn("n", F.col("place") - F.col("among"))
        spans = keys_before.groupBy("file").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("before"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("upto"))
        return files.join(spans, "file")

    def merge(self, rows: DataFrame, deleted: Column | None = None, overwrite_nulls: bool = False, source: str | None = None) -> Merge:
        """A new version with ``rows`` (one per key) merged in, those ``deleted`` taken out.

        Only touched files are read and written anew; the others are part of the
        new version as they are.  A delta without rows makes no version, nor does
        one whose ``source`` (such as a stream's batch) was committed before.
        """
        at = self.state()
        if source is not None and not self.commits().filter(F.col("source") == source).isEmpty():
            return Merge(at["version"], 0, 0, 0, 0, self.files().count(), 0)
        flagged = settled(rows.withColumn("_gone", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)))
        if flagged.isEmpty():
            return Merge(at["version"], 0, 0, 0, 0, self.files().count(), 0)
        gone, alive = flagged.filter("_gone").drop("_gone"), flagged.filter("NOT _gone").drop("_gone")
        keys = [col(k) for k in at["keys"]]
        removed = settled(self.touched(flagged.select(*keys)))
        old = self._rows(at, [r["file"] for r in removed.select("file").collect()])
        known = old.select(*keys)
        updated, dropped = count_matches(alive, known, at["keys"]), count_matches(gone, known, at["keys"])
        merged = upsert(remove_keys(old, gone, at["keys"]), alive, at["keys"], overwrite_nulls)
        new = at | {"version": at["version"] + 1, "base": at["version"], "source": source, "fields": json.dumps(merged.schema.jsonValue())}
        written = self._commit(new, self._write(merged, new), removed)
        rewritten = removed.count()
        return Merge(new["version"], alive.count() - updated, updated, dropped, rewritten, self.files().count() - written, written)
