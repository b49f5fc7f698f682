"""Detecting and masking personal data with JVM expressions only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, existing, string_columns, unused

# The patterns of the entity types, applied in this order.  (?U) keeps \b and \d
# on Unicode word rules whatever the JVM.
PATTERNS = {
    "EMAIL": r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "PHONE": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "IP": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "CREDIT_CARD": r"\b(?:\d[ -]?){13,16}\b",
    "ADDRESS": r"(?i)\b\d{1,5}\s+[A-Z][a-zA-Z\s]{3,40}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct)\b",
    "NAME": r"\b[A-Z][a-z]{1,20}\s+[A-Z][a-z]{1,20}\b",
}
STRATEGIES = ("redact", "hash", "pseudonymize", "generalize")
#: Share of values with a match above which a column counts as personal.
DETECTION_RATE = 0.05
DETECTION_ROWS = 200
#: Re-identification risk above which a table needs a second look.
RISK_THRESHOLD = 0.3


def pattern(entity: str) -> str:
    return "(?U)" + PATTERNS[entity]


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC-SHA-256 from two nested digests with literal pads."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def pseudonym_key(job_id: str, salt: str = "") -> bytes:
    """Key of a job's pseudonyms; a secret ``salt`` keeps others from recomputing them."""
    return hashlib.sha256((job_id + salt).encode()).hexdigest().encode()


def masked_value(entity: str, strategy: str, value: Column, key: bytes) -> Column:
    """What stands for one match."""
    if strategy == "hash":
        return F.concat(F.lit("[HASH:"), F.substring(F.sha2(value.cast("binary"), 256), 1, 16), F.lit("]"))
    if strategy == "pseudonymize":
        return F.concat(F.lit("PSEUDO_"), F.upper(F.substring(hmac_sha256(key, value), 1, 12)))
    if strategy == "generalize":
        return _general(entity, value)
    return F.lit(f"[{entity}_REDACTED]")


def _general(entity: str, value: Column) -> Column:
    n = F.length(value)
    digits = F.regexp_replace(value, r"(?U)\D", "")
    last4 = F.substring(digits, -4, 4)
    plain = F.when(n <= 4, "****").otherwise(F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(value, -2, 2)))
    if entity == "EMAIL":
        parts = F.split(value, "@", -1)
        return F.when(F.size(parts) == 2, F.concat(F.lit("***@"), F.get(parts, F.lit(1)))).otherwise(plain)
    if entity == "PHONE":
        return F.when(F.length(digits) >= 7, F.concat(F.lit("***-***-"), last4)).otherwise(plain)
    if entity == "SSN":
        return F.concat(F.lit("***-**-"), F.substring(value, -4, 4))
    if entity == "CREDIT_CARD":
        return F.when(F.length(digits) >= 4, F.concat(F.lit("****-****-****-"), last4)).otherwise("[CARD_REDACTED]")
    if entity == "IP":
        parts = F.split(value, r"\.", -1)
        return F.when(F.size(parts) == 4, F.concat(F.get(parts, F.lit(0)), F.lit("."), F.get(parts, F.lit(1)), F.lit(".*.*"))).otherwise(plain)
    return plain


def mask_entity(text: Column, entity: str, strategy: str, key: bytes) -> Column:
    """Every match of one entity rewritten; texts without one are returned as they are."""
    rx = pattern(entity)
    if strategy not in ("hash", "pseudonymize", "generalize"):
        return F.regexp_replace(text, rx, f"[{entity}_REDACTED]")
    found = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), lambda v: masked_value(entity, strategy, v, key))
    between = F.split(text, rx, -1)
    # One replacement stands between each two pieces; the last piece has none.
    pieces = F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(rx), F.array_join(pieces, "")).otherwise(text)


def flag_names(df: DataFrame, columns: Iterable[str]) -> dict[str, str]:
    """The name of each masked column's flag: one that ``df`` doesn't use."""
    return {n: unused(df, f"__masked_{n}") for n in existing(df, columns)}


def mask_columns(df: DataFrame, columns: dict[str, dict], job_id: str, salt: str = "") -> DataFrame:
    """Masked columns beside a boolean flag each (``flag_names``): whether any step changed its text.

    Entities are applied one after the other to the text as the earlier ones left
    it.  Each step is its own projection, so expressions stay small, and looks for
    its pattern once: what it changed tells the flag.
    """
    key = pseudonym_key(job_id, salt)
    texts, flags, new = set(string_columns(df)), flag_names(df, columns), unused(df, "masked_text")
    for name, flag in flags.items():
        df = df.withColumn(flag, F.lit(False))
        if name not in texts:
            continue
        for entity in columns[name].get("entity_types") or PATTERNS:
            if entity in PATTERNS:
                df = df.withColumn(new, mask_entity(col(name), entity, columns[name].get("strategy", "redact"), key))
                df = df.withColumns({flag: col(flag) | F.coalesce(col(new) != col(name), F.lit(False)), name: col(new)}).drop(new)
    return df


def detect_pii(df: DataFrame, names: Sequence[str] | None = None, order_by: Sequence[str] | None = None, rows: int = DETECTION_ROWS) -> DataFrame:
    """``column, entity_type, rate`` where more than 5 % of a column's first ``rows`` values match.

    "First" is by ``order_by`` and then by value; nulls are skipped.
    """
    names = list(names if names is not None else string_columns(df))
    parts = []
    for name in names:
        order = existing(df, order_by)
        first = df.filter(col(name).isNotNull()).orderBy(*map(col, order or [name])).limit(rows)
        rates = [F.avg(col(name).rlike(pattern(e)).cast("double")).alias(f"r{i}") for i, e in enumerate(PATTERNS)]
        out = F.array(*[F.struct(F.lit(name).alias("column"), F.lit(e).alias("entity_type"), F.col(f"r{i}").alias("rate")) for i, e in enumerate(PATTERNS)])
        parts.append(first.agg(*rates).select(F.explode(out).alias("r")).select("r.*"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, entity_type string, rate double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.filter(F.col("rate") > DETECTION_RATE)


def reidentification_risk(df: DataFrame, masked: Sequence[str], threshold: float = RISK_THRESHOLD) -> DataFrame:
    """One row ``risk_score, above_threshold``: half the distinct share of masked columns and 0.3 for other nearly unique texts, averaged."""
    texts = string_columns(df)
    if not texts:
        return df.sparkSession.range(1).select(F.lit(0.0).alias("risk_score"), F.lit(threshold < 0).alias("above_threshold"))
    wide = df.agg(F.count("*").alias("n"), *[F.count_distinct(col(c)).alias(f"c{i}") for i, c in enumerate(texts)])
    share = lambda i: F.least(F.col(f"c{i}") / F.greatest(F.col("n"), F.lit(1)), F.lit(1.0))
    parts = [share(i) * 0.5 if c in masked else F.when(share(i) > 0.8, F.lit(0.3)) for i, c in enumerate(texts)]
    known = F.filter(F.array(*parts), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)
    # The limit is held against the score itself, not its rounded form.
    return wide.select(F.round(mean, 4).alias("risk_score"), (mean > threshold).alias("above_threshold"))


@dataclass
class Deidentified:
    dataframe: DataFrame
    audit_log: DataFrame
    pii_columns: dict[str, list[str]]
    risk: DataFrame


def audit(masked: DataFrame, columns: dict[str, dict], job_id: str, tenant_id: str, flags: dict[str, str] | None = None) -> DataFrame:
    """``column, strategy, entity_types, masked_values, job_id, tenant_id`` from the flags of :func:`mask_columns`.

    ``flags`` are the flags' names where they aren't the usual ones.
    """
    flags = flags or {n: f"__masked_{n}" for n in columns}
    names = [n for n in columns if flags.get(n) in masked.columns]
    if not names:
        return masked.sparkSession.createDataFrame([], "column string, strategy string, entity_types array<string>, masked_values bigint, job_id string, tenant_id string")
    wide = masked.agg(*[F.count_if(col(flags[n])).alias(f"n{i}") for i, n in enumerate(names)])
    rows = [F.struct(F.lit(n).alias("column"), F.lit(columns[n].get("strategy", "redact")).alias("strategy"), F.array(*[F.lit(e) for e in columns[n].get("entity_types") or PATTERNS]).alias("entity_types"), F.col(f"n{i}").alias("masked_values"), F.lit(job_id).alias("job_id"), F.lit(tenant_id).alias("tenant_id")) for i, n in enumerate(names)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def deidentify(df: DataFrame, config: dict, job_id: str, tenant_id: str = "default") -> Deidentified:
    """Mask ``columns`` (and, with ``auto_detect``, columns found personal, by redaction); the config isn't changed.

    ``risk_threshold`` is the risk above which the result says so.
    """
    columns = {k: dict(v) for k, v in config.get("columns", {}).items() if k in df.columns}
    found: dict[str, list[str]] = {}
    if config.get("auto_detect"):
        for r in detect_pii(df, order_by=config.get("order_by")).collect():
            found.setdefault(r["column"], []).append(r["entity_type"])
        columns |= {k: {"entity_types": v, "strategy": "redact"} for k, v in found.items() if k not in columns}
    flagged = mask_columns(df, columns, job_id, config.get("salt", ""))
    out = flagged.select(*map(col, df.columns))
    return Deidentified(out, audit(flagged, columns, job_id, tenant_id, flag_names(df, columns)), found, reidentification_risk(out, list(columns), config.get("risk_threshold", RISK_THRESHOLD)))
