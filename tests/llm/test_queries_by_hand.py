"""Registered queries without SQL, against plain Python over a small table with odd rows."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest

from sluiceway.llm import gif, licenses, registry

SECTIONS = {(label, section): text for label, section, text in licenses.TEMPLATES}
TEXTS = [
    (0, "plain words only"),
    (1, None),
    (2, ""),
    (3, "token = abcdef123 and PASSWORD: 'hunter22' api_key=zz9 " + "deadbeef" * 4),
    (4, "AKIA" + "ABCDEFGHIJKLMNOP" + " " + "x" * 900 + " " + "k" * 40 + " https://example.com/path\n\nother " + "q" * 40),
    (5, "Under the MIT License. cc-by nc; Apache License, Version 2.0 and under the mit license"),
    (6, SECTIONS["bsd", "grant"] + " " + SECTIONS["gpl", "notice"]),
    (7, "é\t" * 30_000),
    (None, "token = abcdef123"),
    (3, "token = abcdef123"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    return out


def held(spark, folder, name, columns, want):
    got = registry.queries()[name](spark, folder).select("doc_id", *columns).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *want(t or ""))) for i, t in TEXTS)


def painted(payload: bytes) -> tuple[int, np.ndarray]:
    """Time and colour bins of the stored frames, pixel by pixel: palettes, blanks that let through, and disposal."""
    size = 192 * 32
    frames = [payload[i : i + size] for i in range(0, len(payload), size)]
    canvas: list = [None] * min(size, len(payload))
    bins, ms = np.zeros(64, np.int64), 0
    for n, frame in enumerate(frames):
        before = list(canvas)
        for at, v in enumerate(frame):
            if v != 32:
                canvas[at] = (v, v, v) if n % 2 == 0 else (v & 0xE0, (v & 0x1C) << 3, (v & 3) << 6)
        for c in canvas:
            if c is not None:
                bins[(c[0] >> 6) * 16 + (c[1] >> 6) * 4 + (c[2] >> 6)] += 1
        ms += 100 + 10 * (n % 5)
        if n % 3 == 1:
            canvas[: len(frame)] = [None] * len(frame)
        elif n % 3 == 2:
            canvas = before
    return ms, bins


def test_gif_query(spark, folder):
    def want(text):
        raw = text.encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        ms, bins = painted(payload)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), f"ms={ms};colours={'.'.join(map(str, bins))}"

    got = registry.queries()["op1_gif"](spark, folder).collect()
    mine = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature.split(";", 2)[2].rsplit(";", 1)[0]) for r in got]
    assert sorted(map(str, mine)) == sorted(str((i, *want(t or ""))) for i, t in TEXTS)


def test_gif_of_a_huge_canvas():
    head = b"GIF89a" + struct.pack("<HH", 65535, 65535) + b"\xf7\0\0" + bytes(768)
    frame = b"\x2c" + struct.pack("<HHHH", 0, 0, 65535, 65535) + b"\0" + b"\x08\x02\0\x01\0"
    back = gif.decode(head + frame + b"\x3b")
    assert back is not None and not back.complete and not list(gif.composed(back))


def test_secrets_query(spark, folder):
    kinds = [
        ("assign", r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
        ("access", r"AKIA[A-Z0-9]+"),
        ("hex", r"[0-9a-f]+"),
    ]
    least = {"assign": 6, "access": 20, "hex": 24}

    def want(text):
        spans = [(m.start(), k, kind, m.end()) for k, (kind, rx) in enumerate(kinds) for m in re.finditer(rx, text) if len(m[1] if kind == "assign" else m[0]) >= least[kind]]
        listed = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in sorted(spans))
        return *(sum(x[2] == kind for x in spans) for kind, _ in kinds), hashlib.sha256(listed.encode()).hexdigest()

    held(spark, folder, "op3_secrets", ["n_assign", "n_access", "n_hex", "base_sha256"], want)
    spans = {r["doc_id"]: r["spans"] for r in registry.queries()["op3_secrets"](spark, folder).collect() if r["doc_id"] == 4}[4]
    text = dict(TEXTS[:8])[4]
    at = text.index("k" * 40)
    assert f"linked_secret:{at}:{at + 40}" in spans and "linked_endpoint" in spans and str(text.index("q" * 40)) not in spans


def test_licenses_query(spark, folder):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

    def want(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        found = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        return len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))

    held(spark, folder, "op4_licenses", ["n_words", "n_base", "first_word", "last_word", "base_labels"], want)
    rows = {r["doc_id"]: r for r in registry.queries()["op4_licenses"](spark, folder).collect()}
    assert rows[6]["labels"] == "bsd,gpl" and rows[6]["base_labels"] == "" and rows[6]["score"] == 1.0
