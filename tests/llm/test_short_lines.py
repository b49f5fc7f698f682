"""The registered line join against all pairs: lines of any length, and keys that many lines share."""

from __future__ import annotations

import hashlib
import random

import pytest

from sluiceway.llm import line_dedup, registry

from .test_text_ops import levenshtein


def held_against_all_pairs(spark, tmp_path, lines) -> None:
    lines = sorted(lines)
    spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["line_id"]: r for r in registry.queries()["op5_line_dedup"](spark, str(tmp_path)).collect()}
    md5 = {x: hashlib.md5(x.encode()).hexdigest() for x in lines}
    links = {x: {y for y in lines if x != y and abs(len(x) - len(y)) <= 2 and levenshtein(x, y) <= 2} for x in lines}
    assert {i: r["n_links"] for i, r in got.items()} == {md5[x]: len(links[x]) for x in lines}
    for x in lines:
        seen, todo = {x}, [x]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[md5[x]]["class_id"] == min(md5[y] for y in seen)


def edited(rng: random.Random, line: str, signs: str) -> str:
    copy = list(line)
    for _ in range(rng.randint(1, 3)):
        at = rng.randrange(len(copy)) if copy else 0
        rng.choice([lambda: copy.insert(at, rng.choice(signs)), lambda: copy.pop(at) if copy else None, lambda: copy.__setitem__(at, rng.choice(signs)) if copy else None])()
    return "".join(copy)


def test_short_lines_link(spark, tmp_path):
    rng = random.Random(3)
    lines = {"Home", "Home.", "Contact us", "Contact us!", "é", "ab", "abéc", "xyz", "-"} | {"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 14))) for _ in range(120)}
    held_against_all_pairs(spark, tmp_path, lines)


@pytest.mark.parametrize("hot", [1, 3])
def test_shared_keys_go_down_the_levels(spark, tmp_path, monkeypatch, hot):
    """Variants of a few lines of 1 to 60 characters, where most keys are shared by more lines than one level takes."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "DEEP", 2 * hot)
    rng = random.Random(hot)
    lines = set()
    for size in (1, 2, 3, 5, 8, 13, 21, 34, 60):
        root = "".join(rng.choice("abé ") for _ in range(size))
        lines |= {edited(rng, root, "abé ") for _ in range(14)}
    lines |= {f"Order {rng.randint(100, 999)} of today is on its way to you" for _ in range(30)}
    held_against_all_pairs(spark, tmp_path, lines - {""})


@pytest.mark.parametrize("deep", [8, 512])
def test_every_cut_is_made_once(spark, monkeypatch, deep):
    """A family's cuts are a fixed number of rows a text, whatever its size, and no job makes them again."""
    made, asked, plain = spark.sparkContext.accumulator(0), [], line_dedup._cut

    def counted(rows, tau, probe):
        def work(part):
            for batch in part:
                made.add(batch.num_rows)
                yield batch

        out = plain(rows, tau, probe)
        asked.append((probe, rows.count(), out.count()))
        return out.mapInArrow(work, out.schema)

    monkeypatch.setattr(line_dedup, "_cut", counted)
    monkeypatch.setattr(line_dedup, "DEEP", deep)
    rng = random.Random(7)
    root = "The parcel of your order has left the depot and is on its way to you"
    family = set()
    while len(family) < 150:
        copy = list(root)
        for _ in range(2):
            copy[rng.randrange(len(copy))] = rng.choice("abcdefgh")
        family.add("".join(copy))
    lines = line_dedup.materialise(line_dedup.distinct_lines(spark.createDataFrame(list(enumerate(sorted(family))), "doc_id long, text string")), "lines")
    pairs = {(r["a"], r["b"]) for r in line_dedup.edit_join(lines).collect()}
    text = {r["line_key"]: r["line"] for r in lines.collect()}
    assert pairs == {(a, b) for a in text for b in text if a < b and levenshtein(text[a], text[b]) <= 2}
    assert made.value == sum(n for *_, n in asked) and (len(asked) > 2) == (deep < 150)
    most = {p: max(sum(1 for m in line_dedup._moves(k, 2, p) if m[0] == d) for k in (3, 4, 5) for d in (0, 1, 2)) for p in (False, True)}
    assert all(n <= most[p] * rows for p, rows, n in asked)


def test_a_common_opening_makes_few_rows(spark, monkeypatch):
    """Lines of one opening that differ in the order of eight letters: hardly any pair, and only cuts that keep the opening, once for both sides."""
    made, plain = [], line_dedup._cut

    def counted(rows, tau, probe):
        out = plain(rows, tau, probe)
        made.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(line_dedup, "_cut", counted)
    rng = random.Random(11)
    root = "The parcel of your order has left the depot and is on its way to you, and will be with you in two days"
    family = set()
    while len(family) < 150:
        at = rng.randrange(60, 90)
        family.add(root[:at] + "".join(rng.sample("bcfgjkqz", 8)) + root[at:])
    near = {x[:at] + "x" + x[at + 1 :]: x for x, at in zip(sorted(family)[:40], rng.choices(range(60, 90), k=40), strict=True)}
    family |= set(near)
    lines = line_dedup.materialise(line_dedup.distinct_lines(spark.createDataFrame(list(enumerate(sorted(family))), "doc_id long, text string")), "lines")
    text = {r["line_key"]: r["line"] for r in lines.collect()}
    pairs = [{text[r["a"]], text[r["b"]]} for r in line_dedup.candidates(lines).collect()]
    assert all({x, y} in pairs for x, y in near.items()) and len(pairs) <= 2 * len(family)
    (indexed, index_cuts), (probed, probe_cuts) = made
    assert indexed + probed > len(family) and index_cuts + probe_cuts <= 11 * (indexed + probed)


@pytest.mark.parametrize("tau", [1, 3])
def test_other_numbers_of_edits_go_down_the_levels(spark, monkeypatch, tau):
    monkeypatch.setattr(line_dedup, "HOT", 2)
    monkeypatch.setattr(line_dedup, "DEEP", 6)
    rng = random.Random(20 + tau)
    family = {edited(rng, "Order 12 of today is on its way", "abé ") for _ in range(40)} | {edited(rng, "abé aé", "abé ") for _ in range(25)}
    lines = line_dedup.materialise(line_dedup.distinct_lines(spark.createDataFrame(list(enumerate(sorted(family))), "doc_id long, text string")).filter(f"n_chars > {tau}"), "lines")
    text = {r["line_key"]: r["line"] for r in lines.collect()}
    pairs = {(r["a"], r["b"]) for r in line_dedup.edit_join(lines, tau).collect()}
    assert pairs == {(a, b) for a in text for b in text if a < b and levenshtein(text[a], text[b]) <= tau}


def test_an_edit_changes_few_signs(spark):
    rng = random.Random(12)
    roots = ["".join(rng.choice("abcdé😀 ") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    pairs = spark.createDataFrame([(x, edited(rng, x, "abcdé😀 ")) for x in roots], "x string, y string")
    signs = pairs.withColumns({f"{c}_sign": line_dedup.odd_characters(c) for c in "xy"}).filter("x <> '' and y <> ''")
    assert signs.filter(~line_dedup.alike("x_sign", "y_sign", 3)).count() == 0


@pytest.mark.parametrize("tau", [1, 2, 3, 4])
def test_links_of_short_lines_are_counted(spark, tau):
    rng = random.Random(tau)
    texts = sorted({"".join(rng.choice("abé😀") for _ in range(rng.randint(1, 2 * tau + 1))) for _ in range(150)})
    lines = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(texts)], "line_key long, line string, n_chars long")
    got = {r["line_key"]: r["links"] for r in line_dedup.short_links(lines, tau).collect()}
    want = {i: sum((len(x) <= tau) != (len(y) <= tau) and levenshtein(x, y) <= tau for y in texts) for i, x in enumerate(texts)}
    assert got == {i: n for i, n in want.items() if n}


def test_short_lines_make_no_pairs(spark):
    """Hundreds of short lines around one character, all linked: rows stay a few a line."""
    signs = [chr(0x4E00 + i) for i in range(300)]
    texts = [f"e{x}" for x in signs] + [f"e{x}{y}" for x, y in zip(signs, reversed(signs), strict=True)]
    lines = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(texts)], "line_key long, line string, n_chars long")
    short, longer = line_dedup.patterns(2)
    assert line_dedup._keyed(lines.filter("n_chars < 3"), short, False).count() <= 4 * 300
    assert line_dedup._keyed(lines.filter("n_chars > 2"), longer, True).count() <= 11 * 300
    got = {r["line_key"]: r["links"] for r in line_dedup.short_links(lines).collect()}
    assert got == dict.fromkeys(range(600), 300)


def test_every_alignment_has_a_cut():
    """Whatever two edits do to a text, some cut of it keeps equal pieces of both."""
    rng = random.Random(5)
    for _ in range(3000):
        y = "".join(rng.choice("ab") for _ in range(rng.randint(3, 15)))
        x = edited(rng, y, "ab")
        less = len(x) - len(y)
        if not 0 <= less <= 2 or levenshtein(x, y) > 2:
            continue
        n = len(y)
        for k in {3, min(6, n)}:
            at = lambda i: i * n // k  # noqa: B023, E731
            assert any(
                all(y[at(a) : at(b)] == x[at(a) + t : at(b) + t] and at(b) + t <= len(x) for a, b, t in ((0, b1, 0), (e1, b2, t1), (e2, k, t2)))
                for b1, e1, t1, b2, e2, t2 in line_dedup.cuts(k, 2, less)
            ), (x, y, k)
