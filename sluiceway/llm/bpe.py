"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can end its encoding.  Storing
that token per prefix (``last``) gives the encoding by walking back from the
end.  The table for a prefix depends only on the bytes before it, so text can be
appended, cut back or edited near its end without starting again.

A token may follow another iff encoding the two joined gives back the two
(:meth:`BytePairTable.compatible`); the test undoes merges with the table of
how each token was put together.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, strings

#: Pieces whose encodings a Python worker keeps: a fresh half, and the half before it, which is dropped when the fresh one is full.
CACHE_PIECES = 150_000
#: Pairs of tokens whose compatibility it keeps.
PAIRS = 300_000
_BIG = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class BytePairTable:
    """Ranks with, for each token, the two tokens that its last merge joined."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) == 2:
                    self.halves[rank] = (parts[0], parts[1])
                    self.joined[parts[0], parts[1]] = rank
        self.sizes = {i: len(t) for i, t in self.bytes.items()}
        self.single = {t.decode("latin-1"): i for t, i in ranks.items() if len(t) == 1}
        self.longer = self._automaton(t for t in ranks if len(t) > 1)
        self._fits: dict[int, bool] = {}

    def _automaton(self, tokens: Iterable[bytes]) -> ahocorasick.Automaton:
        """Finds every one of ``tokens`` that ends at a byte, the longest first."""
        found = ahocorasick.Automaton()
        for token in tokens:
            found.add_word(token.decode("latin-1"), (len(token), self.ids[token]))
        found.make_automaton()
        return found

    @cached_property
    def found(self) -> ahocorasick.Automaton:
        return self._automaton(self.ids)

    def _merge(self, piece: bytes, below: int) -> list[int]:
        """Plain merges of ranks under ``below``: only used to build the table."""
        parts = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.joined.get((a, b), _BIG), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [rank]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two tokens."""
        key = left << 32 | right
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        """Replay the merges beside the boundary backwards.

        Merges run in order of rank, equal ranks from the left, and a token's id is
        the rank that made it.  So the piece before the boundary lasts from its own
        rank until that of the token it goes into, and so does the piece behind it.
        Undoing the later of the two each time gives all pairs that ever faced each
        other; one that joins before either is used up crosses the boundary.
        """
        left_until = right_until = _BIG
        while True:
            made = self.joined.get((left, right), _BIG)
            if made < left_until and made <= right_until and made < _BIG:
                return False
            left_parts, right_parts = self.halves.get(left), self.halves.get(right)
            if left_parts is not None and (right_parts is None or left > right):
                left_until, left = left, left_parts[1]
            elif right_parts is not None:
                right_until, right = right, right_parts[0]
            else:
                return True

    def encode(self, data: str) -> list[int]:
        """The encoding of a short byte string, given as Latin-1: the table of :class:`PrefixEncoder`, filled in one go.

        Where no longer token fits, the prefix ends in the token of its last byte:
        some token must, so that one needs no test.
        """
        fits, known = self.compatible, self._fits.get
        try:
            last = [self.single[byte] for byte in data]
        except KeyError:
            raise ValueError("a byte has no token") from None
        done = -1
        for at, (length, token) in self.longer.iter(data):
            if at == done:
                continue
            if length <= at:
                left = last[at - length]
                if (fit := known(left << 32 | token)) is None:
                    fit = fits(left, token)
                if not fit:
                    continue
            last[at] = token
            done = at
        sizes, at, out = self.sizes, len(data), []
        while at:
            token = last[at - 1]
            out.append(token)
            at -= sizes[token]
        return out[::-1]


class PrefixEncoder:
    """The encoding of a growing or edited byte string, one last token per prefix."""

    def __init__(self, table: BytePairTable, data: bytes = b""):
        self.table = table
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the string; the entries of earlier prefixes stay as they are.

        Of the tokens that end at a byte the longest compatible one is stored.
        """
        last, fits = self.last, self.table.compatible
        start = len(self.data)
        self.data += more
        back = max(0, start - self.table.longest)
        size = start
        for at, (length, token) in self.table.found.iter(self.data[back:].decode("latin-1")):
            end = back + at + 1
            if end == size + 1:
                begin = end - length
                if begin == 0 or (begin > 0 and fits(last[begin - 1], token)):
                    last.append(token)
                    size = end
        if size != len(self.data):
            raise ValueError("a byte has no token")

    def truncate(self, size: int) -> None:
        """Cut the string back to its first ``size`` bytes."""
        del self.data[size:]
        del self.last[size:]

    def replace(self, begin: int, end: int, new: bytes) -> int:
        """Put ``new`` for ``data[begin:end]``; how many entries were worked out.

        An entry hangs only on the bytes and entries of one longest token before it.
        So once that many entries behind the edit are what they were, all that
        follow are too, and stay.
        """
        last, fits, longest = self.last, self.table.compatible, self.table.longest
        self.data[begin:end] = new
        moved = len(new) - (end - begin)
        fresh: list[int] = []
        size, same, total = begin, 0, len(self.data)
        stop = min(total, begin + len(new) + 2 * longest)
        while size < total and same < longest:
            low = max(0, size - longest)
            for at, (length, token) in self.table.found.iter(self.data[low:stop].decode("latin-1")):
                if low + at != size:
                    continue
                before = size + 1 - length
                if before < 0 or (before and not fits(last[before - 1] if before <= begin else fresh[before - 1 - begin], token)):
                    continue
                fresh.append(token)
                size += 1
                if size > begin + len(new):
                    same = same + 1 if last[size - 1 - moved] == token else 0
                    if same >= longest:
                        break
            if size < stop and same < longest:
                raise ValueError("a byte has no token")
            stop = min(total, stop + 4 * longest)
        last[begin : size - moved] = fresh
        return len(fresh)

    def tokens(self, size: int | None = None) -> list[int]:
        """The encoding of the first ``size`` bytes (all by default)."""
        at = len(self.last) if size is None else size
        out = []
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.table.bytes[token])
        return out[::-1]


class TextEncoder:
    """Whole texts: split by a pattern, each match encoded apart from the others.

    A match is remembered by itself: a word has one encoding whatever stands beside it.
    """

    def __init__(self, table: BytePairTable, pattern: str):
        self.table = table
        self.pieces = regex.compile(pattern).findall
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """The ids of a match that wasn't found among the fresh ones."""
        # The fresh half may have been changed for another in the middle of a text.
        if (packed := self.new.get(piece) or self.old.get(piece)) is None:
            ids = self.table.encode(piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1"))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.new) >= CACHE_PIECES // 2:
                self.old, self.new = self.new, {}
            self.new[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        find, work = self.new.get, self._piece
        return b"".join([find(piece) or work(piece) for piece in self.pieces(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder per worker process; its tables are read once from the vocabulary file."""
    return TextEncoder(BytePairTable(read_ranks(path)), pattern)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``ids`` (array of int) and ``decoded`` (the bytes those ids stand for).

    ``vocabulary`` is the path of a rank file that every executor can open.
    Null texts count as empty and give no ids.  Long texts are encoded whole;
    cost grows in proportion to length.  Ids may repeat or be null.
    """
    return _run(docs, vocabulary, pattern, id_col, text_col, full=True)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_texts`, but with digests: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    The ids stay inside the worker, so nothing wider than a digest leaves it.
    """
    return _run(docs, vocabulary, pattern, id_col, text_col, full=False)


def _run(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, full: bool) -> DataFrame:
    schema = pa.schema([("row_id", pa.int64())] + ([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if full else [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, pattern)

        def rows() -> Iterator[tuple]:
            for batch in part:
                for row_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                    ids = coder.encode(text)
                    back = coder.decode(ids)
                    if full:
                        yield row_id, np.frombuffer(ids, "<u4").astype("int32"), back
                    else:
                        yield row_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

        yield from batches(rows(), schema)

    kinds = "row_id long, ids array<int>, decoded binary" if full else "row_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col)).mapInArrow(work, kinds)
    return out.withColumnRenamed("row_id", id_col)
