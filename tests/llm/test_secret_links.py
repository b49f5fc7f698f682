"""Linked credentials through the registered query, against a search scope by scope and pair by pair."""

from __future__ import annotations

import random
import re

from sluiceway.llm import registry

ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def by_hand(text):
    """Base and linked spans as ``kind:start:end``, by start and then by kind."""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base = list(found)
    at = 0
    for gap in [*re.finditer(r"\n[^\S\n]*\n", text), None]:
        end = gap.start() if gap else len(text)
        mine = [f for f in base if at <= f[0] < end]
        if any(f[1] == 1 for f in mine):
            weak = [(at + m.start(), 3, "linked_secret", at + m.end()) for m in re.finditer(r"[A-Za-z0-9/+]+", text[at:end]) if len(m[0]) == 40]
            hosts = [(at + m.start(), 4, "linked_endpoint", at + m.end()) for m in re.finditer(r"https?://[^\s\"'<>]+|(?<![\w.-])(?:[a-z0-9-]+\.)+(?:com|net|org|io|cloud|internal)(?::\d+)?(?![\w.-])", text[at:end])]
            found += weak + (hosts if weak or any(f[1] != 1 for f in mine) else [])
        at = end
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


def test_links_of_many_scopes_and_identifiers(spark, tmp_path):
    rng = random.Random(11)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJ0123456789") for _ in range(rng.choice([12, 16, 20])))
    weak = lambda: "".join(rng.choice(ALNUM) for _ in range(rng.choice([39, 40, 40, 40, 41])))
    parts = [key, weak, lambda: "db.example.net:5432", lambda: "https://example.com/a?b=c", lambda: "not.a-host.example", lambda: "password = hunter22", lambda: "token: abc", lambda: "ab" * 12, lambda: "é", lambda: "plain words", lambda: "secret=" + "z" * 40]
    texts = []
    for _ in range(150):
        scopes = ["\n".join(" ".join(rng.choice(parts)() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4))]
        texts.append(rng.choice(["\n\n", "\n \t\n", "\n\n\n"]).join(scopes))
    texts += [None, "", "\n\n", key(), f"{key()} vault.example.com", f"{key()} {key()}\n{weak()}" + " x" * 2000 + " h.example.io"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in registry.op3_secrets(spark, str(tmp_path)).collect()}
    want = {i: by_hand(t or "") for i, t in enumerate(texts)}
    assert got == want and sum("linked_secret" in w for w in want.values()) > 20 and sum("linked_endpoint" in w for w in want.values()) > 20
