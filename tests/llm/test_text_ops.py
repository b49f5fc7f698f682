"""Kernels and operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluiceway.llm import bpe, exact_dedup, gif, jaccard_join, language_id, licenses, line_dedup, mixture, registry, secrets, toxicity
from sluiceway.llm.components import connected_components

from ..conftest import DATA, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, score string"
EDGE = [(1, None, "en", None, None, 9, "x"), (2, "", None, "b", 0, 9, "x"), (3, "  \t", "en", "a", 3, 9, "x"), (3, "  \t", "en", "a", 3, 9, "x"), (None, "one two", "en", "é", 7, None, None), (5, "one  two", "fr", "b", 8, 9, "x"), (6, "word " * 60_000, "en", "a", 300_000, 9, "x")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- GIF -------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw_round_trip(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_lzw_clears_a_full_table():
    data = np.random.default_rng(1).integers(0, 256, 40_000).astype(np.uint8).tobytes() + b"a" * 50_000
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)) == data


def test_disposal_and_transparency():
    red_blue = np.zeros((256, 3), np.uint8)
    red_blue[1], red_blue[2] = (255, 0, 0), (0, 0, 255)
    full = np.full((2, 2), 1, np.uint8)
    dot = np.array([[0, 2], [0, 0]], np.uint8)
    frames = [gif.Frame(0, 0, full, red_blue, 100, 1), gif.Frame(0, 0, dot, red_blue, 50, 3, 0), gif.Frame(0, 0, np.zeros((1, 1), np.uint8), red_blue, 70, 2, 0)]
    back = gif.decode(gif.encode(frames, 2, 2, loops=0))
    assert back.loops == 0 and back.complete and [f.delay_ms for f in back.frames] == [100, 50, 70]
    pictures = list(gif.composed(back))
    assert pictures[0][0, 1].tolist() == [255, 0, 0, 255]
    assert pictures[1][0, 1].tolist() == [0, 0, 255, 255] and pictures[1][1, 1].tolist() == [255, 0, 0, 255]
    assert pictures[2][0, 1].tolist() == [255, 0, 0, 255]  # the second frame was taken back


def test_broken_gifs():
    good = gif.store_bytes(b"x" * 192)
    assert gif.decode(None) is None and gif.decode(b"PNG") is None
    for cut in range(13, len(good), 7):
        assert gif.decode(good[:cut]).complete is False or cut == len(good)


def test_interlaced_rows():
    w, h = 3, 9
    picture = np.arange(27, dtype=np.uint8).reshape(h, w)
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    data = bytearray(gif.encode([gif.Frame(0, 0, picture[order], gif.GREYS)], w, h))
    at = data.index(b"\x2c\0\0\0\0")
    data[at + 9] |= 0x40
    assert gif.decode(bytes(data)).frames[0].indices.tolist() == picture.tolist()


def test_stored_texts(spark, edge, empty):
    got = rows(gif.store_texts(edge), "doc_id")
    assert len(got) == len(EDGE) and gif.store_texts(empty).count() == 0
    for row in got:
        text = next((r[1] or "") for r in EDGE if r[0] == row["doc_id"]).encode()
        payload = text + b" " * (192 - len(text) % 192 if len(text) % 192 or not text else 0)
        assert (row["n_bytes"], row["payload_bytes"]) == (len(text), len(payload))
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest() and row["tail_crc32"] == zlib.crc32(payload[-16:])
    media = gif.store_texts(edge, keep_media=True)
    shown = gif.frames(media, "doc_id", "media")
    assert shown.filter("doc_id = 6").count() == -(-(-(-300_000 // gif.ROW)) // gif.ROWS)
    assert gif.frames(spark.createDataFrame([(1, None), (2, bytearray(b"no"))], "i long, m binary"), "i", "m").count() == 0


# --- mixing ----------------------------------------------------------------


def test_mix_budgets(spark, docs, edge, empty):
    from pyspark.sql import functions as F

    size = mixture.word_count(F.col("text"))
    got = rows(mixture.mix_sources(docs, size), "doc_id")
    again = rows(mixture.mix_sources(docs.repartition(7), size), "doc_id")
    assert got == again
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) < len(by)
    for part in by.values():
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 0.5
        assert part[0]["target"] <= 2 * part[0]["source_size"] + 1e-6
    assert mixture.mix_sources(empty, size).count() == 0
    assert len(rows(mixture.mix_sources(edge, size))) == len(EDGE)


# --- secrets ---------------------------------------------------------------


def test_base_spans_and_linking():
    key, secret = "AKIA" + "Z" * 16, "q1" * 20
    near = f"id {key}\n{secret}\nhost vault.example.com\n\nother {secret[::-1]}"
    base = secrets.base_spans(near)
    linked = secrets.link(near, base)
    assert [secrets.KINDS[k] for _, k, _ in linked] == ["linked_secret", "linked_endpoint"]
    assert near[linked[0][0] : linked[0][2]] == secret
    assert secrets.link(f"{secret} vault.example.com", secrets.base_spans(secret)) == []
    far = f"{key}" + " " * 900 + secret
    assert secrets.link(far, secrets.base_spans(far), 400) == [] and len(secrets.link(far, secrets.base_spans(far))) == 1
    assert [(k) for _, k, _ in secrets.base_spans("PassWord = 'abcdef' secret:token:abcdefgh")] == [0]
    assert secrets.base_spans("ſecret=abcdefgh " + "a" * 23) == []


def test_interval_join_is_complete():
    rng = random.Random(5)
    for _ in range(100):
        make = lambda: [(s, s + rng.randint(1, 6)) for s in (rng.randint(0, 30) for _ in range(rng.randint(0, 8)))]
        a, b = make(), make()
        want = {(i, j) for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if s < f and t < e}
        assert set(secrets.interval_join(a, b)) == want


def test_secret_rows(spark, edge, empty):
    assert secrets.find_secrets(empty).count() == 0
    assert all(r["spans"] == [] for r in rows(secrets.find_secrets(edge)))


# --- licences --------------------------------------------------------------


def test_suffix_automaton_statistics():
    rng = random.Random(2)
    texts = [[rng.randint(0, 2) for _ in range(30)] for _ in range(3)]
    automaton = licenses.SuffixAutomaton(texts)
    probe = [rng.randint(0, 3) for _ in range(60)]

    def inside(part):
        return any(part == t[i : i + len(part)] for t in texts for i in range(len(t)))

    for i, (length, state) in enumerate(automaton.statistics(probe)):
        want = max(n for n in range(i + 2) if n == 0 or inside(probe[i - n + 1 : i + 1]))
        assert length == want
        part = probe[i - length + 1 : i + 1]
        for number, text in enumerate(texts) if length else ():
            assert automaton.ends[state].get(number, []) == [e for e in range(length - 1, len(text)) if text[e - length + 1 : e + 1] == part]


def test_license_places_and_chains(spark, edge, empty):
    scan = licenses.Scanner()
    words = licenses.words_of(b"Released under the MIT License. under the mit license\xc3\xa9 cc-by-nc")
    assert scan.places(words) == [(1, "mit"), (9, "cc-by-nc")]
    bsd = next(t for label, section, t in licenses.TEMPLATES if (label, section) == ("bsd", "grant"))
    changed = bsd.replace("binary forms", "compiled or binary forms")
    assert [c[0] for c in scan.chains(licenses.words_of(b"x y " + changed.encode()))] == ["bsd"]
    assert scan.chains(licenses.words_of(b"redistribution and use in the wild")) == []
    assert licenses.scan_licenses(empty).count() == 0
    got = rows(licenses.scan_licenses(edge), "doc_id")
    assert all(r["labels"] == "" and r["score"] == 0 for r in got) and max(r["n_words"] for r in got) == 60_000


# --- lines -----------------------------------------------------------------


def levenshtein(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def test_edit_join_finds_all(spark):
    rng = random.Random(9)
    lines = set()
    for _ in range(25):
        root = "".join(rng.choice("abé") for _ in range(rng.randint(32, 40)))
        lines.add(root)
        for _ in range(4):
            copy = list(root)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(copy))
                rng.choice([lambda: copy.insert(at, rng.choice("ab")), lambda: copy.pop(at), lambda: copy.__setitem__(at, rng.choice("abé"))])()
            lines.add("".join(copy))
    lines = sorted(x for x in lines if len(x) >= 32)
    got = rows(line_dedup.near_duplicate_lines(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")))
    md5 = {x: hashlib.md5(x.encode()).hexdigest() for x in lines}
    links = {x: [y for y in lines if x != y and levenshtein(x, y) <= 2] for x in lines}
    by = {r["line_id"]: r for r in got}
    assert len(got) == len(lines)
    for x in lines:
        assert by[md5[x]]["n_links"] == len(links[x])
        seen, todo = {x}, [x]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        assert by[md5[x]]["class_id"] == min(md5[y] for y in seen)


def test_lines_of_odd_tables(spark, edge, empty):
    assert line_dedup.near_duplicate_lines(empty).count() == 0
    got = rows(line_dedup.near_duplicate_lines(edge))
    assert {r["n_rows"] for r in got if r["n_chars"] == 3} == {2}
    assert sorted(r["n_chars"] for r in got if r["n_links"]) == [7, 8] and sum(not r["kept"] for r in got) == 1


# --- byte pairs ------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as p

    return bpe.encoder(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)


@pytest.fixture(scope="module")
def reference_coder(coder):
    import public_tokenizers as p
    import tiktoken

    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=coder.table.ids, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abeé ñß語🙂\n\t'sT.,!<|>1 "), max_size=80))
def test_encodes_like_the_library(coder, reference_coder, text):
    ids = np.frombuffer(coder.encode(text), "<u4").tolist()
    assert ids == reference_coder.encode_ordinary(text)
    assert coder.decode(coder.encode(text)).decode() == text


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=20), st.integers(0, 40), st.integers(0, 40))
def test_appends_and_edits(coder, data, more, a, b):
    a, b = sorted((min(a, len(data)), min(b, len(data))))
    grown = bpe.PrefixEncoder(coder.table, data)
    fresh = lambda x: bpe.PrefixEncoder(coder.table, x).tokens()
    grown.append(more)
    assert grown.tokens() == fresh(data + more)
    assert grown.tokens(len(data)) == fresh(data)
    grown.replace(a, b, more)
    assert grown.tokens() == fresh((data + more)[:a] + more + (data + more)[b:])


def test_encoded_rows(spark, docs, edge, empty, reference_coder):
    import public_tokenizers as p

    path = p.path("byte_bpe_multi_50k.tiktoken")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows(bpe.encode_texts(docs, path, p.PATTERN)):
        assert r["ids"] == reference_coder.encode_ordinary(text[r["doc_id"]]) and r["decoded"].decode() == text[r["doc_id"]]
    assert bpe.encode_texts(empty, path, p.PATTERN).count() == 0
    short = {r["doc_id"]: r["n_tokens"] for r in rows(bpe.encode_digests(edge, path, p.PATTERN))}
    assert short[1] == short[2] == 0 and short[6] > 0


# --- toxicity and language -------------------------------------------------


def test_folding_and_exceptions():
    assert toxicity.fold("1D10t, іdіоt!") == " idiot idiot "
    model = toxicity.Model(((" trash ", 3.0), (" lowei", 2.0)), curve=(-2.0, 1.0, 1.0))
    assert toxicity.weigh(model, "Trash lowein 7r@sh")[0] == 8.0
    assert toxicity.weigh(model, "a trash can, slowei")[0] == 0.0
    assert 0 <= model.score("") < 0.5 < model.score("trash " * 3)


def test_toxicity_held_out(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in rows(toxicity.score_toxicity(docs, model))}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [d for d in truth if got[d]["held_out"]]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert sum(got[d]["predicted"] == truth[d] for d in held) / len(held) > 0.9
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).score("x") < 0.5
    assert len(rows(toxicity.score_toxicity(edge, model))) == len(EDGE) and toxicity.score_toxicity(empty, model).count() == 0


def test_language_held_out(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language_id.fit(docs)
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in rows(language_id.identify(docs, known)) if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    odd = {r["doc_id"]: r for r in rows(language_id.identify(edge, known))}
    assert odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[3]["lang_pred"] == "und" and 0 <= odd[6]["score"] <= 1
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0


def test_ngrams_by_hand():
    text = "Ab c"
    want = ["a", "b", "c", "_a", "ab", "b_", "_c", "c_", "_ab", "ab_", "b_c", "_c_"]
    code = lambda g: sum((1 if x == "_" else ord(x) + 1) << 21 * i for i, x in enumerate(reversed(g)))
    assert sorted(language_id.ngrams(text).tolist()) == sorted(map(code, want))


# --- exact and near copies -------------------------------------------------


def test_exact_groups(spark, edge, empty):
    got = rows(exact_dedup.exact_groups(edge, partitions=3))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    assert sorted(r["text_sha256"] for r in got) == sorted(hashlib.sha256(norm(t).encode()).hexdigest() for _, t, *_ in EDGE)
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    two = hashlib.sha256(b"one two").hexdigest()
    assert by[None, two]["keep_id"] == 5 and not by[None, two]["kept"] and by[5, two]["kept"] and by[5, two]["group_size"] == 2
    blank = hashlib.sha256(b"").hexdigest()
    assert by[1, blank]["kept"] and not by[2, blank]["kept"]
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 3, 5, 6]


def near_copies(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(6))
    texts = []
    for _ in range(12):
        root = [word() for _ in range(rng.randint(3, 80))]
        for _ in range(6):
            copy = list(root)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts + ["", None, "Same Words here", "same words HERE", "  "]


def test_jaccard_components(spark, edge, empty):
    texts = near_copies()

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if v == b else v for v in label]
    got = rows(jaccard_join.near_duplicate_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    assert jaccard_join.near_duplicate_components(empty).count() == 0
    odd = rows(jaccard_join.near_duplicate_components(edge))
    assert len(odd) == len(EDGE) and all(r["component_id"] == 5 for r in odd if r["doc_id"] in (None, 5))


def one_family(count: int) -> list[np.ndarray]:
    rng = np.random.default_rng(3)
    root = rng.integers(0, 1 << 48, 60).astype(np.uint64)
    return [np.unique(np.where(rng.random(60) < rng.uniform(0, 0.4), rng.integers(0, 1 << 48, 60).astype(np.uint64), root)) for _ in range(count)]


def linked(sets: list[np.ndarray]) -> set[tuple[int, int]]:
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - c)}


def named_by_least(pairs, count: int) -> list[int]:
    label = list(range(count))
    for _ in range(count):
        before = list(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label
    return label


def test_dual_traversal_visits_every_link():
    sets = one_family(300)
    n = np.array([len(s) for s in sets])
    trees = [jaccard_join.SignatureTree(np.arange(at, 300, 2), n, sets) for at in (0, 1)]
    met = set()

    def visit(a, b, ok):
        met.update((min(a[i], b[j]), max(a[i], b[j])) for i, j in zip(*np.nonzero(ok), strict=True))

    for x, y in ((0, 0), (0, 1), (1, 1)):
        jaccard_join.dual_traversal(trees[x], trees[y], 75, lambda a, b: False, visit)
    true = linked(sets)
    assert true and true <= met and len(met) < 300 * 299 // 2


def test_a_task_ties_all_that_links():
    """Links out of one task are few, true, and tie what all pairs tie."""
    import pyarrow as pa

    sets = one_family(300)
    table = pa.table({"task": [1] * 300, "cls": list(range(300)), "n": [len(s) for s in sets], "comp": list(range(300)), "side": [0] * 300, "hub": [i == 7 for i in range(300)], "tokens": [jaccard_join.pack_tokens(s) for s in sets]})
    (out,) = list(jaccard_join._join_tasks(75)(iter(table.to_batches())))
    found = set(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    true = linked(sets)
    assert found <= true and len(found) < 300 and named_by_least(found, 300) == named_by_least(true, 300)


def test_blocks_of_one_large_family(spark, monkeypatch):
    """A family cut into many blocks has the components that all pairs give, and makes no row for a pair."""
    rng = random.Random(8)
    root = [f"w{i}" for i in range(70)]
    texts = [" ".join(w if rng.random() > share else f"x{rng.random()}" for w in root) for share in [rng.uniform(0, 0.06) for _ in range(400)]]
    shingles = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    true = [(i, j) for i in range(400) for j in range(i + 1, 400) if 100 * (c := len(shingles[i] & shingles[j])) >= 75 * (len(shingles[i]) + len(shingles[j]) - c)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 3_000)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    join = jaccard_join.JaccardJoin(table)
    links, _ = join.links()
    assert links.count() < 4 * 400 < len(true)
    got = rows(jaccard_join.near_duplicate_components(table), "doc_id")
    label = named_by_least(true, 400)
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)]
    table = spark.createDataFrame(edges, "a long, b long")
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    want = {x: label[x] for x in linked}
    for bound in (1_000, -1):
        assert {r["node"]: r["component"] for r in connected_components(table, bound).collect()} == want


# --- registered queries ----------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = registry.queries()[name](spark, str(DATA))
    names = sorted(got.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    result = con.execute(registry.oracle_sql()[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == names
    want = sorted(tuple(plain(r[theirs.index(c)]) for c in names) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == want


def test_a_hot_text_fills_several_ranges(spark):
    """One text in a third of all rows, read by forty tasks: no range holds all its buffers, and its group stays whole."""
    docs = spark.createDataFrame([(i, "the same\ttext" if i % 3 == 0 else "the same  text" if i == 1 else f"text {i % 50}") for i in range(900)], "doc_id long, text string").repartition(40)
    ranges = exact_dedup.sorted_texts(docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("body")), 20).withColumn("range", F.spark_partition_id())
    assert ranges.filter(F.col("body") == b"the same text").select("range").distinct().count() > 1
    want = {}
    for i, x in docs.collect():
        want.setdefault(" ".join(x.split()), []).append(i)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs, partitions=20).collect()}
    assert got == {i: (min(ids), len(ids)) for ids in want.values() for i in ids}
