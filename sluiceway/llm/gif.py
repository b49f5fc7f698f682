"""GIF columns: LZW streams, palettes, disposal, transparency and timed frames.

:func:`decode` reads any GIF87a/89a byte string into frames; :func:`frames`
turns a binary column into one row per timed frame with the composed picture and
its colour histogram.  :func:`encode` writes one, which is how arbitrary bytes
are stored as 8-bit samples (:func:`store_bytes`) and read back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, utf8

#: Samples in a stored row, and rows in a frame: at most 6 KiB of samples to a frame.
ROW = 192
ROWS = 32
#: Pixels that a frame or canvas may have beyond what its file has samples for.
SLACK = 1 << 22
#: Palette of stored bytes: index i is the grey (i, i, i).
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
#: The other palette of stored bytes: three bits of red, three of green, two of blue.
COLOURS = np.stack([np.arange(256) & 0xE0, np.arange(256) << 3 & 0xE0, np.arange(256) << 6 & 0xC0], 1).astype(np.uint8)


@dataclass
class Frame:
    """One image block: indices as stored (de-interlaced) and what its control block says."""

    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame]
    loops: int | None = None
    complete: bool = True


def _widths(count: int, start: int) -> np.ndarray:
    """Bits of the codes after a clear code: the decoder's table has grown by one entry less than codes read."""
    entries = (1 << start) + 1 + np.arange(count)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, start + 1, 12)


_WIDTHS = {start: _widths(1 << 14, start) for start in range(2, 9)}


def lzw_encode(data: bytes) -> bytes:
    """Variable-width LZW of 8-bit samples; a full table is cleared."""
    clear, stop = 256, 257
    runs: list[list[int]] = []
    codes = [clear] if not data else []
    table: dict[int, int] = {}
    free = 258
    it = iter(data)
    prefix = next(it, 0)
    for byte in it:
        key = prefix << 8 | byte
        if (code := table.get(key)) is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = byte
        if free < 4096:
            table[key] = free
            free += 1
        else:
            codes.append(clear)
            runs.append(codes)
            codes, table, free = [], {}, 258
    if data:
        codes.append(prefix)
    codes.append(stop)
    runs.append(codes)
    all_codes = np.fromiter((c for r in ([clear], *runs) for c in r), np.int64)
    bits = np.concatenate([[9], *(_WIDTHS[8][: len(r)] if len(r) <= 1 << 14 else np.full(len(r), 12) for r in runs)])
    spread = (all_codes[:, None] >> np.arange(12)) & 1
    return np.packbits(spread[np.arange(12) < bits[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _codes(data: bytes, start: int) -> Iterator[tuple[list[int], bool]]:
    """Runs of codes between clear codes, without them; True with the run that a stop code ends."""
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    window = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    clear, stop = 1 << start, (1 << start) + 1
    at, total, pending = 0, 8 * len(data), []
    done = 0
    while True:
        bits = _WIDTHS[start][done : done + 4096]
        if len(bits) < 4096:
            bits = np.full(4096, 12)
        begins = at + np.concatenate(([0], np.cumsum(bits)))
        fit = int(np.searchsorted(begins[1:], total, side="right"))
        if not fit:
            yield pending, False
            return
        begins, bits = begins[: fit + 1], bits[:fit]
        codes = window[begins[:-1] >> 3] >> (begins[:-1] & 7) & (1 << bits) - 1
        ends = np.flatnonzero((codes == clear) | (codes == stop))
        if not len(ends):
            pending += codes.tolist()
            at, done = int(begins[-1]), done + fit
            continue
        end = int(ends[0])
        pending += codes[:end].tolist()
        yield pending, bool(codes[end] == stop)
        if codes[end] == stop:
            return
        at, done, pending = int(begins[end + 1]), 0, []


def lzw_decode(data: bytes, start: int, size: int) -> bytes:
    """At most ``size`` samples; a stream that breaks off or misnames a code gives what came before."""
    base = [bytes([i]) for i in range(1 << start)] + [b"", b""]
    out: list[bytes] = []
    got = 0
    for codes, last in _codes(data, start):
        table = base.copy()
        add, put = table.append, out.append
        before = b""
        free = len(table)
        for code in codes:
            if code < free:
                entry = table[code]
                if before and free < 4096:
                    add(before + entry[:1])
                    free += 1
            elif code == free and before:
                entry = before + before[:1]
                add(entry)
                free += 1
            else:
                return b"".join(out)[:size]
            put(entry)
            before = entry
            got += len(entry)
        if last or got >= size:
            break
    return b"".join(out)[:size]


def encode(frames: list[Frame], width: int, height: int, loops: int | None = None) -> bytes:
    """GIF89a with one global palette (the first frame's) and local ones where they differ."""
    table = frames[0].palette if frames else GREYS
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", table.tobytes()]
    if loops is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + loops.to_bytes(2, "little") + b"\0")
    for f in frames:
        h, w = f.indices.shape
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + bytes([flags]) + (f.delay_ms // 10).to_bytes(2, "little") + bytes([f.transparent or 0, 0]))
        own = f.palette is not table and not np.array_equal(f.palette, table)
        out.append(b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (f.left, f.top, w, h)) + (b"\x87" + f.palette.tobytes() if own else b"\0"))
        code = lzw_encode(f.indices.tobytes())
        out.append(b"\x08" + b"".join(bytes([len(code[i : i + 255])]) + code[i : i + 255] for i in range(0, len(code), 255)) + b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and (n := data[at]):
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(out), at + 1


def decode(data: bytes | None) -> Gif | None:
    """The frames of a GIF; None where the bytes are no GIF.  A broken file gives the frames before the break."""
    if not data or data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return None
    word = lambda i: int.from_bytes(data[i : i + 2], "little")
    palette_at = lambda i, flags: (np.frombuffer(data[i : i + (n := 3 << (flags & 7) + 1)].ljust(n, b"\0"), np.uint8).reshape(-1, 3), i + n)
    gif, at, table = Gif(word(6), word(8), []), 13, GREYS
    if data[10] & 0x80:
        table, at = palette_at(13, data[10])
    delay = disposal = 0
    transparent = None
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return gif
        if kind == 0x21 and at + 1 < len(data):
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                delay, disposal = 10 * int.from_bytes(body[1:3], "little"), body[0] >> 2 & 7
                transparent = body[3] if body[0] & 1 else None
            elif data[at + 1] == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                gif.loops = int.from_bytes(body[12:14], "little")
            at = after
        elif kind == 0x2C and at + 10 < len(data):
            left, top, w, h, flags = word(at + 1), word(at + 3), word(at + 5), word(at + 7), data[at + 9]
            palette, at = palette_at(at + 10, flags) if flags & 0x80 else (table, at + 10)
            start = data[at] if at < len(data) else 0
            body, at = _blocks(data, at + 1)
            if not 2 <= start <= 8:
                break
            samples = np.frombuffer(lzw_decode(body, start, w * h), np.uint8)
            if w * h > len(samples) + SLACK:
                break
            if len(samples) < w * h:
                gif.complete = False
            grid = np.concatenate((samples, np.zeros(w * h - len(samples), np.uint8))).reshape(h, w)
            if flags & 0x40:
                order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
                straight = np.empty_like(grid)
                straight[order] = grid
                grid = straight
            gif.frames.append(Frame(left, top, grid, palette, delay, disposal, transparent))
            delay = disposal = 0
            transparent = None
        else:
            break
    gif.complete = False
    return gif


def composed(gif: Gif) -> Iterator[np.ndarray]:
    """The RGBA picture of each frame after disposal and transparency rules; none where the canvas is far larger than all frames."""
    if gif.width * gif.height > sum(f.indices.size for f in gif.frames) + SLACK:
        return
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        h = max(0, min(f.indices.shape[0], gif.height - f.top))
        w = max(0, min(f.indices.shape[1], gif.width - f.left))
        index = f.indices[:h, :w]
        part = canvas[f.top : f.top + h, f.left : f.left + w]
        shown = np.ones(index.shape, bool) if f.transparent is None else index != f.transparent
        part[shown, :3] = f.palette[np.minimum(index[shown], len(f.palette) - 1)]
        part[shown, 3] = 255
        yield canvas.copy()
        if f.disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before


def histogram(picture: np.ndarray) -> list[int]:
    """Opaque pixels by colour: 64 bins, two bits a channel."""
    seen = picture[picture[..., 3] == 255]
    bins = (seen[:, 0] >> 6).astype(np.int64) << 4 | (seen[:, 1] >> 6) << 2 | seen[:, 2] >> 6
    return np.bincount(bins, minlength=64).tolist()


def frames(media: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """One row per frame: id, frame_no, start_ms, delay_ms, width, height, rgba, histogram.

    Null, empty and foreign bytes give no rows; a broken GIF gives the frames
    before the break.  Ids may be null or repeat.
    """
    schema = pa.schema([("row_id", pa.int64()), ("frame_no", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), ("histogram", pa.list_(pa.int64()))])

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in part:
                for row_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if (gif := decode(data)) is None:
                        continue
                    clock = 0
                    for n, (f, picture) in enumerate(zip(gif.frames, composed(gif), strict=False)):
                        yield row_id, n, clock, f.delay_ms, gif.width, gif.height, picture.tobytes(), histogram(picture)
                        clock += f.delay_ms

        yield from batches(rows(), schema, size=64)

    out = media.select(F.col(id_col).cast("long").alias("row_id"), F.col(gif_col)).mapInArrow(work, "row_id long, frame_no int, start_ms long, delay_ms long, width int, height int, rgba binary, histogram array<long>")
    return out.withColumnRenamed("row_id", id_col)


def store_bytes(payload: bytes) -> bytes:
    """A GIF whose samples are ``payload``, whose length is a positive multiple of ``ROW``.

    Frames take the grey and the coloured palette in turn, are kept, cleared and
    undone in turn, and let the frame below show through at blanks.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    parts = [Frame(0, 0, rows[i : i + ROWS], (GREYS, COLOURS)[n % 2], 100 + 10 * (n % 5), 1 + n % 3, 32) for n, i in enumerate(range(0, len(rows), ROWS))]
    return encode(parts, ROW, min(ROWS, len(rows)))


def described(gif: Gif) -> str:
    """Frames, canvas, time, the opaque pixels of all pictures in 64 colour bins, and a digest of each picture's start and bins."""
    clock, total, line = 0, np.zeros(64, np.int64), hashlib.sha256()
    for f, picture in zip(gif.frames, composed(gif), strict=False):
        bins = histogram(picture)
        total += bins
        line.update(f"{clock}:{'.'.join(map(str, bins))};".encode())
        clock += f.delay_ms
    return f"frames={len(gif.frames)};canvas={gif.width}x{gif.height};ms={clock};colours={'.'.join(map(str, total))};timeline={line.hexdigest()[:16]}"


def padded(text: bytes) -> bytes:
    """``text`` and blanks up to a positive multiple of ``ROW``."""
    return text + b" " * (-len(text) % ROW or (ROW if not text else 0))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text as a GIF, decode the stored bytes again, and describe both.

    id, ``n_bytes``, ``payload_bytes``, ``payload_sha256``, ``tail_crc32``,
    ``media_bytes``, ``media_sha256``, ``feature`` (``described`` of the composed
    frames, read back) and, with ``keep_media``, ``media``.  Null texts count as
    empty, and an empty text as one row of blanks; equal texts give equal values,
    ids may be null or repeat, and other columns aren't read.
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema([("row_id", pa.int64()), *zip(names, types, strict=True)] + [("media", pa.binary())] * keep_media)

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in part:
                for row_id, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                    media = store_bytes(padded(text))
                    gif = decode(media)
                    payload = b"".join(f.indices.tobytes() for f in gif.frames)
                    row = (row_id, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), described(gif))
                    yield (*row, media) if keep_media else row

        yield from batches(rows(), schema)

    kinds = "row_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    out = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col)).mapInArrow(work, kinds)
    return out.withColumnRenamed("row_id", id_col)
