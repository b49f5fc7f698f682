"""Exact de-duplication by content sort.

Equal texts become neighbours in a range-partitioned, externally sorted
sequence; comparing each text with the one before it in full finds the groups,
and the smallest identifier of a group stays.

Shape of the job
----------------
1. *Combine*: each input partition folds its own repeats to one row per text
   (bounded buffer), so a text that makes up a third of the corpus enters the
   shuffle once per buffer, not once per row.
2. *Range shuffle*: Spark samples the short key ``(first 32 bytes, digest, least id
   of the buffer)`` for its splitters; full texts travel once and never reach the
   driver.  The digest behind the prefix separates texts that share a boilerplate
   opening, and the id cuts a text that many buffers held over several ranges.
3. *Neighbour scan*: rows sorted by ``(prefix, digest, text)`` are compared in
   full with their predecessor; narrow runs of one digest come together.
4. *Label*: the ``(digest -> kept id, size)`` table joins back to narrow
   ``(id, digest)`` rows; AQE may split a hot digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, batches, shuffle_partitions, unused, utf8

#: Bytes of distinct text that one task holds while it folds repeats.
COMBINE_BYTES = 32 << 20
_PREFIX = 32

_KEYED = pa.schema([("row_id", pa.int64()), ("digest", pa.binary())])
_REPS = pa.schema([("prefix", pa.binary()), ("digest", pa.binary()), ("body", pa.binary()), ("row_id", pa.int64()), ("n", pa.int64())])
_RUNS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def normalise(text: bytes) -> bytes:
    """Replace each run of ASCII blanks by one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    return (b" " if text[0] in BLANKS else b"") + b" ".join(words) + (b" " if text[-1] in BLANKS else b"")


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _keyed(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in part:
        digests = [hashlib.sha256(normalise(t)).digest() for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary())], schema=_KEYED)


def _combine(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in part:
            for row_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                body = normalise(text)
                if (seen := held.get(body)) is not None:
                    seen[0] = smaller(seen[0], row_id)
                    seen[1] += 1
                    continue
                held[body] = [row_id, 1]
                size += len(body) + 100
                if size >= COMBINE_BYTES:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    def flush(held: dict[bytes, list]) -> Iterator[tuple]:
        for body, (row_id, n) in held.items():
            yield body[:_PREFIX], hashlib.sha256(body).digest(), body, row_id, n

    yield from batches(rows(), _REPS)


def _runs(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        digest = body = None
        keep, n = None, 0
        for batch in part:
            for d, b, i, k in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True):
                if b == body:
                    keep, n = smaller(keep, i), n + k
                    continue
                if digest is not None:
                    yield digest, keep, n
                digest, body, keep, n = d, b, i, k
        if digest is not None:
            yield digest, keep, n

    yield from batches(rows(), _RUNS)


def sorted_texts(base: DataFrame, partitions: int) -> DataFrame:
    """Texts of ``base(row_id, body)``, folded where they are read, in sorted ranges.

    Splitters are sampled from a prefix, a digest and the least id that a buffer
    held: what many buffers held is cut over several ranges.
    """
    return (
        base.mapInArrow(_combine, "prefix binary, digest binary, body binary, row_id long, n long")
        .repartitionByRange(partitions, "prefix", "digest", "row_id")
        .sortWithinPartitions("prefix", "digest", "body", "row_id")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Null texts count as empty; texts of blanks only equal a single space.  A
    null id is never the kept one (``kept`` is false, and ``keep_id`` is null if
    a whole group has none).  The id names a row: where a table repeats the kept
    id with an equal text, each repeat says ``kept``.  Other columns, whatever
    they are called, are not read.  An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body"))
    n = partitions or shuffle_partitions(docs.sparkSession)
    runs = sorted_texts(base, n).mapInArrow(_runs, "digest binary, keep_id long, group_size long")
    # A text that many buffers held may fill several ranges: their counts come together, not the texts.
    # The hash beside the digest gives the join a shuffle of its own, which adaptive execution may split for a hot digest.
    runs = runs.groupBy("digest", F.xxhash64("digest").alias("spot")).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).drop("spot")
    keyed = base.mapInArrow(_keyed, "row_id long, digest binary")
    return keyed.join(runs, "digest").select(
        F.col("row_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("row_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group of equal texts; all columns stay.

    Ids must name rows: rows whose id is null, or that repeat the id of a copy, go
    with it.  Give rows numbers of their own where a table can't promise that.
    """
    name = unused(docs, "gone")
    gone = exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias(name))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
