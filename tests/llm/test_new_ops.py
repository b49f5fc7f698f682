"""Fill-in-the-middle, URL reputation and filter audit against brute force, and over odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluiceway.llm import fill_middle as fim
from sluiceway.llm import filter_audit as audit
from sluiceway.llm import registry
from sluiceway.llm import url_filter as urls

from ..conftest import DATA, rows
from .test_text_ops import EDGE, SCHEMA

LONG = "A line of words\r\nnext é🙂\n\n" * 40_000


# --- fill in the middle ------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\ré🙂<PSM>"), max_size=90))
def test_units_are_those_of_the_patterns(text):
    data = text.encode()
    wanted = {"line": r"[^\n]*\n|[^\n]+", "word": r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "char": r"(?s:.)"}
    for unit, pattern in wanted.items():
        pieces = [p.encode() for p in re.findall(pattern, text)]
        bits = fim.starts(data, unit)
        assert bits.bit_count() == len(pieces)
        places = [sum(map(len, pieces[:i])) for i in range(len(pieces))]
        assert [fim.select(bits, i) for i in range(len(pieces))] == places


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab\n<PSM>é "), max_size=60), st.integers(-5, 10**12), st.sampled_from(["line", "word", "char"]))
def test_restored_from_output_and_form(text, row_id, unit):
    data = text.encode()
    for spm in (0, 50, 100):
        cut = fim.split(data, row_id, unit, spm=spm)
        assert fim.restore(cut.output(), cut.form) == data == cut.prefix + cut.middle + cut.suffix
        assert (cut.form == "plain") == (not data or any(m in data for m in fim.MARKS))
        assert spm == 50 or cut.form in ("plain", "psm" if spm == 0 else "spm")
    assert fim.split(data, row_id, unit, rate=0).form == "plain"


def test_broken_outputs():
    for output, form in ((b"no marks", "psm"), (b"<P>a<S>b", "psm"), (b"<P>a<S>b<M>c", "spm")):
        with pytest.raises(ValueError):
            fim.restore(output, form)
    with pytest.raises(ValueError):
        fim.fill_middle(None, unit="page")


def test_rearranged_rows(spark):
    """The registered digests against slices of the matched lines."""
    table = [*EDGE, (8, LONG, "en", "a", 0, 0, ""), (9, "has <M> in it\nand more", "en", "a", 0, 0, ""), (10, "\n\n", "en", "a", 0, 0, "")]
    made = rows(fim.fill_middle(spark.createDataFrame(table, SCHEMA)))
    assert len(made) == len(table)
    by = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in made)
    want: Counter = Counter()
    for row_id, text, *_ in table:
        text = text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        n, digest = len(units), hashlib.sha256(f"7:{'' if row_id is None else row_id}".encode()).hexdigest()
        h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
            want[row_id, n, "plain", None, None, text, text] += 1
        elif h[3] % 100 < 50:
            want[row_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text] += 1
        else:
            want[row_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text] += 1
    assert by == want
    assert fim.fill_middle(spark.createDataFrame([], SCHEMA)).count() == 0


# --- host reputation -----------------------------------------------------------


def test_hosts_paths_and_domains(spark):
    cases = [
        ("http://WWW.Example.ORG/en/1?x=/y#z", "www.example.org", "/en/1", "example.org", "org"),
        ("no scheme", "", "", "", ""),
        (None, "", "", "", ""),
        ("https://a.b.co.uk?q=http://c", "a.b.co.uk", "", "b.co.uk", "co.uk"),
        ("https://co.uk/x", "co.uk", "/x", "co.uk", "uk"),
        ("ftp://user@h.example.com:80/é", "user@h.example.com:80", "/é", "example.com", "com"),
        ("x://10.0.0.7:9/a", "10.0.0.7:9", "/a", "10.0.0.7", ""),
        ("x://localhost#f", "localhost", "", "localhost", ""),
        ("://É.example.net./p", "É.example.net.", "/p", "example.net", "net"),
        ("a://b://c/d", "b:", "//c/d", "b", ""),
        ("http://", "", "", "", ""),
    ]
    table = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, url string")
    host = urls.url_host(F.coalesce("url", F.lit("")))
    got = rows(table.select("i", host.alias("h"), urls.url_path(F.coalesce("url", F.lit(""))).alias("p"), urls.registered_domain(host).alias("d"), urls.suffix_of(urls.registered_domain(host)).alias("s")), "i")
    assert {(r["i"], r["h"], r["p"], r["d"], r["s"]) for r in got} == {(i, *c[1:]) for i, c in enumerate(cases)}


def test_longest_rule_wins(spark):
    cases = [("org", "/", "org/"), ("org", "", None), ("x.org", "/a", "org/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("b.example.org", "/es/", "example.org/es/"), ("badexample.org", "/es/", "org/"), ("a.com", "/fr/1", "com/fr/"), ("a.com", "/en/", None), ("a.org:80", "/", None)]
    table = spark.createDataFrame(cases, "h string, p string, want string")
    got = table.select("want", urls.longest_rule(F.col("h"), F.col("p"), registry.URL_RULES).alias("r")).collect()
    assert all((r["r"] and r["r"]["rule"]) == r["want"] for r in got)
    assert urls.longest_rule(F.lit("a"), F.lit("/"), ()) is not None


def test_beta_tail_by_adding_up():
    for a, b in ((0.6, 1.3), (5.0, 15.0), (120.5, 300.0), (2000.0, 6000.0), (3.0, 0.7)):
        for limit in (0.05, 0.24, 0.5, 0.9):
            steps = 200_000
            grid = ((i + 0.5) / steps for i in range(steps))
            norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
            over = sum(math.exp(norm + (a - 1) * math.log(x) + (b - 1) * math.log1p(-x)) for x in grid if x > limit) / steps
            assert abs(urls.tail(a, b, limit) - over) < 2e-3
    assert urls.tail(2, 2, 0) == 1 and urls.tail(2, 2, 1) == 0 and abs(urls.tail(4, 4, 0.5) - 0.5) < 1e-12


def likeliest(children):
    totals = [sum(urls.log_likelihood(k, n, m, g) for k, n, m in children if n > 1) for g in urls.STRENGTHS]
    return max((g for g, t in zip(urls.STRENGTHS, totals, strict=True) if t >= max(totals) - 1e-6), default=urls.STRENGTHS[-1])


def test_reputations_by_hand(spark):
    """Strengths, posterior means and tails of every host against plain Python, a bad domain among them."""
    rng = random.Random(3)
    counts = []
    for d in range(12):
        rate = 0.8 if d == 3 else rng.uniform(0.1, 0.3)
        for h in range(rng.randint(1, 8)):
            n = rng.choice([0, 1, 2, 5, 40])
            counts.append((f"h{h}.d{d}.{'net' if d % 2 else 'org'}", n, sum(rng.random() < rate for _ in range(n))))
    got = {r["host"]: r for r in urls.reputations(spark.createDataFrame(counts, "host string, n long, bad long")).collect()}
    whole = (sum(c[2] for c in counts) + 0.5) / (sum(c[1] for c in counts) + 1)
    by = {"d": {}, "s": {}}
    for host, n, bad in counts:
        _, d, s = host.split(".")
        for kind, key in (("d", f"{d}.{s}"), ("s", s)):
            was = by[kind].get(key, (0, 0))
            by[kind][key] = (was[0] + bad, was[1] + n)
    mean = {"": whole}
    for kind, parent in (("s", lambda k: ""), ("d", lambda k: k.split(".")[1])):
        g = likeliest([(k, n, mean[parent(key)]) for key, (k, n) in by[kind].items()])
        mean |= {key: (k + g * mean[parent(key)]) / (n + g) for key, (k, n) in by[kind].items()}
    up = lambda host: host.split(".", 1)[1]
    g = likeliest([(k, n, mean[up(host)]) for host, n, k in counts])
    assert len(got) == len(counts)
    for host, n, k in counts:
        a, b = k + g * mean[up(host)], n - k + g * (1 - mean[up(host)])
        assert abs(got[host]["rate"] - a / (a + b)) < 1e-9 and abs(got[host]["above"] - urls.tail(a, b, whole)) < 1e-9
        assert got[host]["domain"] == up(host) and got[host]["suffix"] == host.rsplit(".", 1)[1]
    assert all((r["above"] > 0.95) == (r["domain"] == "d3.net") for r in got.values() if r["n"] >= 40)
    # A host of the bad domain that has no outcome of its own is suspected through the domain.
    fresh = urls.reputations(spark.createDataFrame([*counts, ("new.d3.net", 0, 0), ("new.d4.org", 0, 0)], "host string, n long, bad long"))
    seen = {r["host"]: r["rate"] for r in fresh.collect()}
    assert seen["new.d3.net"] > 0.5 > seen["new.d4.org"]


def test_pages_of_odd_tables(spark):
    pages = [(1, "http://a.example.net/en/5", 7, "x"), (1, "http://a.example.net/en/5", 7, "x"), (None, None, None, None), (3, "nothing", 0, ""), (4, "http://a.example.net/en/99999999999999999999", 0, ""), (5, "x://" + "a." * 5000 + "net/en/6", 0, "")]
    schema = "page_id long, url string, n long, bad string"
    labels = spark.createDataFrame([(5, 0, None), (5, 1, 0), (6, 1, None), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = rows(urls.filter_pages(spark.createDataFrame(pages, schema), labels, registry.URL_RULES))
    assert len(got) == len(pages) and {r["verdict"] for r in got} <= {"allow", "block"}
    host = next(r for r in got if r["host"] == "a.example.net")
    assert (host["n_labelled"], host["n_bad"]) == (2, 2)
    assert {(r["page_id"], r["host"], r["path"]) for r in got if not r["host"]} == {(None, "", ""), (3, "", "")}
    assert urls.filter_pages(spark.createDataFrame([], schema), labels, registry.URL_RULES).count() == 0
    bare = rows(urls.filter_pages(spark.createDataFrame(pages, schema), labels.limit(0), ()))
    assert {(r["verdict"], r["above"], r["rule"]) for r in bare} == {("allow", 0.0, None)}


# --- audit -----------------------------------------------------------------------


def audited(table, labels):
    """The contract's report, row by row and order by order."""
    flags = []
    marks = {}
    for d, q, t in labels:
        was = marks.get(d, (0, 0))
        marks[d] = (was[0] or q == 1, was[1] or t == 1)
    for row_id, text, part in table:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = row_id is not None and any(i is not None and i < row_id and (t or "") == text for i, t, _ in table)
        good, toxic = marks.get(row_id, (0, 0)) if row_id is not None else (0, 0)
        flags.append((part or "", "".join(c for c in "ABCDE" if fails[c]), bool(good), bool(toxic)))
    out = {}
    for part in {f[0] for f in flags}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [f for f in flags if f[0] == part]
            for step, c in enumerate(order, 1):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                failing = sum(f[0] == part and c in f[1] for f in flags)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f[0] == part and f[1] == c for f in flags), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_by_brute_force(spark):
    rng = random.Random(6)
    words = ["alpha", "beta", "Gamma", "DELTA", "x#", "née", "\t", "one"]
    table = [(i, " ".join(rng.choice(words[: rng.randint(1, 8)]) + str(rng.randint(0, 90)) * (rng.random() < 0.7) for _ in range(rng.choice([3, 49, 50, 120]))), rng.choice(["s", "t", None, ""])) for i in range(60)]
    table += [(i + 100, table[i * 3][1], "t") for i in range(12)] + [(100, table[0][1], "t"), (None, table[0][1], "s"), (None, None, None), (7, None, "u"), (200, "", "u"), (201, "Word " * 60_000, "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 110, 2)] + [(2, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in table], "doc_id long, text string, source string, part long, digest string")
    got = audit.audit_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    have = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows(got)}
    assert have == audited(table, labels) and got.count() == len(have)


def test_audit_of_no_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    assert audit.audit_documents(docs.limit(0), labels).count() == 0
    got = rows(audit.audit_documents(docs, labels.limit(0)))
    assert {(r["good_lost"], r["toxic_lost"]) for r in got} == {(0, 0)} and len(got) == 600 * len({r["part"] for r in got})


def test_exact_patterns_and_any_filters(spark):
    rng = random.Random(1)
    table = [(rng.choice("pq"), *(rng.random() < 0.4 for _ in range(3))) for _ in range(200)]
    frame = spark.createDataFrame(table, "part string, x boolean, y boolean, z boolean")
    joint = audit.joint_failures(frame, F.col("part"), {"x": F.col("x"), "y": F.col("y"), "z": F.col("z")}, {"rows": F.lit(1)})
    patterns = {r["part"]: r["e"] for r in joint.select("part", audit.exactly(F.col("joint_rows"), 3).alias("e")).collect()}
    want = Counter((p, x + 2 * y + 4 * z) for p, x, y, z in table)
    assert patterns == {p: [want[p, t] for t in range(8)] for p in "pq"}
    report = rows(audit.order_report(joint, "xyz", {}))
    assert len(report) == 2 * 6 * 3 and all(sum(r["shapley"] for r in report if (r["part"], r["filter_order"]) == (p, "xyz")) == 6 * (sum(q == p for q, *_ in table) - want[p, 0]) for p in "pq")
    for flags in ({}, {"long": F.lit(1)}, {c: F.lit(1) for c in "abcdefgh"}):
        with pytest.raises(ValueError):
            audit.joint_failures(frame, F.col("part"), flags, {"rows": F.lit(1)})
