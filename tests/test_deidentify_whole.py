"""The de-identification queries over every document, against Python's re."""

from __future__ import annotations

import hashlib
import hmac
import re

import duckdb
import pytest

from sluiceway import queries
from sluiceway.operators import deidentify

TEXTS = [
    (1, "Écrire à jean.dupré@exemple.fr ou à anna@exemple.fr, IP 10.0.0.1."),
    (2, "Größe: über 4111 1111 1111 1111 gezahlt, Müller Straße, Anna Schmidt, Tel. 555-123-4567"),
    (3, "é10.0.0.1 und 10.0.0.1é bleiben, ß 192.168.1.20 ß nicht; ñ123-45-6789, ñ 123-45-6789"),
    (4, "plain a@b.org 10.1.2.3 and John Smith"),
    (5, ""),
    (6, None),
    (7, "señor josé@correo.es;maría.lópez@correo.es 8.8.8.8"),
]
KEY = hashlib.sha256(b"job").hexdigest().encode()


def redacted(text):
    for entity, rx in deidentify.PATTERNS.items():
        text = re.sub(rx, f"[{entity}_REDACTED]", text)
    return text


WANT = {
    "dei_redact": redacted,
    "dei_hash": lambda t: re.sub(deidentify.PATTERNS["EMAIL"], lambda m: f"[HASH:{hashlib.sha256(m[0].encode()).hexdigest()[:16]}]", t),
    "dei_pseudonymize": lambda t: re.sub(deidentify.PATTERNS["IP"], lambda m: "PSEUDO_" + hmac.new(KEY, m[0].encode(), "sha256").hexdigest()[:12].upper(), t),
    "dei_generalize": lambda t: re.sub(deidentify.PATTERNS["EMAIL"], lambda m: "***@" + m[0].split("@")[1], t),
}


@pytest.fixture(scope="module", params=["fixture", "/root/testdata/sf0.01"])
def folder(request, spark, tmp_path_factory):
    if request.param != "fixture":
        return request.param
    out = str(tmp_path_factory.mktemp("accents"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    return out


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(WANT))
def test_masks_every_document(spark, folder, texts, name):
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES[name](spark, folder).collect()}
    assert got == {i: t if t is None else WANT[name](t) for i, t in texts.items()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/{'documents.parquet' if folder.startswith('/root/testdata') else 'documents.parquet/*.parquet'}'")
    assert got == dict(con.execute(queries.SQL[name]).fetchall())


def test_detects_and_audits_every_document(spark, folder, texts):
    planted = [" a.b@c.org", " 123-45-6789", " 10.0.0.1", " (555) 123-4567", " Anna Smith"]
    first = [(t or "") + planted[i % 5] for i, t in sorted(texts.items())][: deidentify.DETECTION_ROWS]
    rates = {e: sum(bool(re.search(rx, t)) for t in first) / len(first) for e, rx in deidentify.PATTERNS.items()}
    got = {r["entity_type"]: r["rate"] for r in queries.QUERIES["dei_detect"](spark, folder).collect()}
    assert got and got == {e: round(v, 6) for e, v in rates.items() if v > deidentify.DETECTION_RATE}
    (row,) = queries.QUERIES["dei_audit"](spark, folder).collect()
    assert row["masked_values"] == sum(bool(t and re.search(deidentify.PATTERNS["EMAIL"], t)) for t in texts.values())
