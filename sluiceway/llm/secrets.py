"""Secret scan with multipart credential linking.

Some secrets show themselves (an assignment to a password, an access key id, a
long hexadecimal string).  Others are weak: forty base-64 characters or a host
name mean little alone.  A *scope* is a stretch of lines without an empty line
between them.  Every access identifier opens an interval: its whole scope, or
``reach`` characters to both sides in it where a reach is given; weak parts that
overlap such an interval are joined to it by a sweep over both sorted lists.  A weak secret is reported once
it is joined to an identifier, an endpoint once it is joined to an identifier
that also has a secret.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strings

#: In the order in which kinds stand where two spans begin together.
KINDS = ("assign", "access", "hex", "linked_secret", "linked_endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+])")
_ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|(?<![\w.-])(?:[a-z0-9-]+\.)+(?:com|net|org|io|cloud|internal)(?::\d+)?(?![\w.-])")
_SCOPE_END = re.compile(r"\n[^\S\n]*\n")

Span = tuple[int, int, int]  # start, index into KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the kinds that stand alone, leftmost and non-overlapping in each kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def interval_join(lefts: list[tuple[int, int]], rights: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Index pairs of overlapping half-open intervals, by one sweep over both lists sorted by start."""
    order = sorted(range(len(rights)), key=rights.__getitem__)
    waiting, live = 0, []
    for i in sorted(range(len(lefts)), key=lefts.__getitem__):
        begin, end = lefts[i]
        while waiting < len(order) and rights[order[waiting]][0] < end:
            live.append(order[waiting])
            waiting += 1
        live = [j for j in live if rights[j][1] > begin]
        yield from ((i, j) for j in live if rights[j][0] < end)


def link(text: str, base: list[Span], reach: int | None = None) -> list[Span]:
    """Weak parts that occur with their complements in a scope, or within ``reach`` characters of an identifier in it.

    Spans are those of the whole text, whatever the reach: it cuts no span short.
    """
    ids = [(s, e) for s, k, e in base if k == 1]
    if not ids:
        return []
    ends = [m.start() for m in _SCOPE_END.finditer(text)]
    bounds = [0, *ends, len(text)]

    scopes = sorted({bisect.bisect_right(ends, begin) for begin, _ in ids})

    def around(span: tuple[int, int]) -> tuple[int, int]:
        at = bisect.bisect_right(ends, span[0])
        if reach is None:
            return bounds[at], bounds[at + 1]
        return max(bounds[at], span[0] - reach), min(bounds[at + 1], span[1] + reach)

    windows = [around(x) for x in ids]
    # Matching scopes with an identifier only; a scope ends before a line feed, which no weak part holds.
    weak = [m.span() for at in scopes for m in _WEAK_SECRET.finditer(text, bounds[at], bounds[at + 1])]
    points = [m.span() for at in scopes for m in _ENDPOINT.finditer(text, bounds[at], bounds[at + 1])]
    strong = [(s, e) for s, k, e in base if k != 1]
    if reach is None:
        # Identifiers of one scope have one interval: it stands once.
        windows = sorted(set(windows))
    secret_hits = list(interval_join(windows, weak))
    backed = {i for i, _ in secret_hits} | {i for i, _ in interval_join(windows, strong)}
    linked = {weak[j] for _, j in secret_hits}
    ends_linked = {points[j] for i, j in interval_join(windows, points) if i in backed}
    return sorted([(s, 3, e) for s, e in linked] + [(s, 4, e) for s, e in ends_linked])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """id and ``spans``: an array of (kind, start, end) in code points, end exclusive, by start and kind.

    Base kinds are ``assign``, ``access`` and ``hex``; linking adds
    ``linked_secret`` and ``linked_endpoint``, within whole scopes unless ``reach`` is given.  Null and empty texts have no
    spans.  Whole texts are read.  Ids may be null or repeat; other columns aren't
    read; an empty table gives no rows.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in part:
            out = []
            for text in strings(b.column(1)):
                base = base_spans(text)
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + link(text, base, reach))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(span))], names=["row_id", "spans"])

    out = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col)).mapInArrow(work, "row_id long, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("row_id", id_col)
