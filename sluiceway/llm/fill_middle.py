"""Fill-in-the-middle transformation by big-integer bit-parallelism.

A text is looked at as bits, one a byte: ``bytes.translate`` turns it into the
digits of a class (is this byte a line feed? a blank? the start of a code point?),
and ``int`` packs the digits into one big integer.  Shifts and boolean operations
on whole integers mark where units begin, ``bit_count`` counts them, and the bit of
a given rank is found by halving: the lower half's count tells which half holds it,
so the work is n + n/2 + ... bits.  No loop runs over characters.

Units are lines (with their line feed), words (with the blanks after them; blanks
that open a text are a unit) or code points.  Where the two cuts fall and how the
parts are put together hangs only on a digest of the row's id and seed, so any rerun
gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, batches, utf8

#: Signs before prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
FORMS = ("plain", "psm", "spm")


def _class(members) -> bytes:
    """A table for ``bytes.translate``: digit 1 for members, 0 for others."""
    return bytes(49 if b in members else 48 for b in range(256))


_FEED = _class(b"\n")
_BLANK = _class(BLANKS)
#: Bytes that begin a code point: all but UTF-8's continuation bytes.
_POINT = _class([b for b in range(256) if b & 0xC0 != 0x80])


def mask(data: bytes, table: bytes) -> int:
    """Bit i says whether byte i is in the class."""
    return int(data[::-1].translate(table) or b"0", 2)


def starts(data: bytes, unit: str = "line") -> int:
    """Bit i says whether a unit begins at byte i."""
    everything = (1 << len(data)) - 1
    if unit == "char":
        return mask(data, _POINT)
    if unit == "line":
        return (mask(data, _FEED) << 1 | 1) & everything
    if unit == "word":
        blank = mask(data, _BLANK)
        return (~blank & (blank << 1) | 1) & everything
    raise ValueError(f"no unit {unit!r}")


def select(bits: int, rank: int) -> int:
    """Place of the set bit that ``rank`` set bits precede."""
    base, width = 0, bits.bit_length()
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        if rank < (count := low.bit_count()):
            bits, width = low, half
        else:
            bits, width, base, rank = bits >> half, width - half, base + half, rank - count
    return base


def draws(row_id: int | None, seed: int = 7, count: int = 4) -> list[int]:
    """The first 8-digit groups of the digest of seed and id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 8 * count, 8)]


@dataclass(frozen=True)
class Parts:
    """A text cut in three, and the form its parts are put together in."""

    n: int
    form: str
    prefix: bytes
    middle: bytes
    suffix: bytes

    def output(self) -> bytes:
        p, s, m = MARKS
        if self.form == "psm":
            return p + self.prefix + s + self.suffix + m + self.middle
        if self.form == "spm":
            return s + self.suffix + p + self.prefix + m + self.middle
        return self.prefix + self.middle + self.suffix


def split(data: bytes, row_id: int | None, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7) -> Parts:
    """Cut ``data`` at two drawn units.

    Empty texts, texts that hold a mark, and all but ``rate`` of 100 rows stay
    plain; of the others ``spm`` of 100 have their suffix first.
    """
    at = starts(data, unit)
    n = at.bit_count()
    h1, h2, h3, h4 = draws(row_id, seed)
    if not data or h3 % 100 >= rate or any(m in data for m in MARKS):
        return Parts(n, "plain", data, b"", b"")
    first, second = (len(data) if k == n else select(at, k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return Parts(n, "spm" if h4 % 100 < spm else "psm", data[:first], data[first:second], data[second:])


def restore(output: bytes, form: str) -> bytes:
    """The text that ``output`` was made of.  No part holds a mark, so the first of each is the one put in."""
    p, s, m = MARKS
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError(f"no {form} output")
    one, found, rest = output[len(first) :].partition(second)
    two, again, middle = rest.partition(m)
    if not found or not again:
        raise ValueError(f"no {form} output")
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """Each text rearranged: id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``, ``restored``.

    ``restored`` is the text rebuilt from ``output`` and ``form`` alone.  Null texts
    count as empty and are plain, as are texts that hold a mark; plain rows have
    null lengths.  Ids may be null (they draw alike) or repeat; other columns
    aren't read; an empty table gives no rows.  One map over whole texts, a row at
    a time: no shuffle, and no more memory than a few copies of a text.
    """
    schema = pa.schema([("row_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("restored", pa.string())])
    if unit not in ("line", "word", "char"):
        raise ValueError(f"no unit {unit!r}")

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in part:
                for row_id, data in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                    cut = split(data, row_id, unit, rate, spm, seed)
                    chars = [None, None] if cut.form == "plain" else [mask(x, _POINT).bit_count() for x in (cut.prefix, cut.middle)]
                    made = cut.output()
                    yield row_id, cut.n, cut.form, *chars, made, restore(made, cut.form)

        yield from batches(rows(), schema)

    out = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col)).mapInArrow(work, "row_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
    return out.withColumnRenamed("row_id", id_col)
