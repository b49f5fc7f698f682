"""Licence chains, byte-pair edits and digests, lexicons and rank profiles against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import pytest

from sluiceway.llm import bpe, language_id, licenses, mixture, registry, toxicity

from ..conftest import DATA, rows

# --- licences ------------------------------------------------------------------


def naive_chains(scan, words):
    """Matches by trying every place, chained as the scanner says, over all templates."""
    texts = [licenses.words_of(t.encode()) for *_, t in scan.templates]
    known = {w for t in texts for w in t}

    def longest(i):
        best, where = 0, {}
        for n, t in enumerate(texts):
            for e in range(len(t)):
                k = 0
                while k <= e and k <= i and words[i - k] == t[e - k]:
                    k += 1
                if k > best:
                    best, where = k, {}
                if k and k == best:
                    where.setdefault(n, []).append(e)
        return best, where

    stats = [longest(i) if words[i] in known else (0, {}) for i in range(len(words))]
    chains, done = {}, []
    for i, (length, where) in enumerate(stats):
        if length < scan.shortest or (i + 1 < len(stats) and stats[i + 1][0] > length):
            continue
        first = i - length + 1
        for n, places in where.items():
            c = chains.get(n)
            later = [e for e in places if c and e > c[2]]
            if c and i > c[1] and first - c[1] - 1 <= scan.gap and later:
                c[3] += min(length, i - c[1], later[0] - c[2])
                c[1], c[2] = i, later[0]
            else:
                if c:
                    done.append((n, c))
                chains[n] = [first, i, places[0], length]
    done += chains.items()
    good = [(*scan.templates[n][:2], c[0], c[1], c[3] / len(texts[n]), c[3]) for n, c in done if c[3] >= scan.cover * len(texts[n])]
    good.sort(key=lambda g: (-g[5], -g[4], g[:4]))
    out = []
    for g in good:
        if all(o[0] == g[0] or g[2] < o[2] or g[3] > o[3] for o in out):
            out.append(g)
    return sorted(o[:5] for o in out)


def test_chains_by_brute_force():
    """Edits, gaps, left-out parts and repeated passages in small random templates."""
    rng = random.Random(12)
    for _ in range(150):
        word = lambda: rng.choice("abcdefgh")
        texts = [[word() for _ in range(rng.randint(6, 25))] for _ in range(3)]
        texts[1][3:3] = texts[0][2:9]
        texts[2] += texts[2][:6]
        scan = licenses.Scanner(tuple((f"l{i % 2}", f"s{i}", " ".join(t)) for i, t in enumerate(texts)), shortest=3, gap=2, cover=0.5)
        probe: list[str] = []
        for _ in range(4):
            part = list(rng.choice(texts))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(part))
                rng.choice([lambda: part.insert(at, "x"), lambda: part.pop(at) if len(part) > 1 else None, lambda: part.__setitem__(at, word()), lambda: part.__setitem__(slice(at, at + 3), [])])()
                part = part or ["x"]
            probe += ["y"] * rng.randint(0, 4) + part
        words = licenses.words_of(" ".join(probe).encode())
        assert scan.chains(words) == naive_chains(scan, words)


def test_every_section_is_known_by_itself():
    scan = licenses.Scanner()
    for label, section, text in licenses.TEMPLATES:
        found = scan.chains(licenses.words_of(f"code before {text} code after".encode()))
        assert (label, section) in {f[:2] for f in found}
        assert {f[0] for f in found} == {label}, (label, section, found)


def test_a_licence_with_edits(spark):
    by = {(a, b): t for a, b, t in licenses.TEMPLATES}
    file = "// header\n" + by["bsd", "conditions"].replace("binary form", "object or binary form").replace("documentation", "manual") + "\nint main() {}\n" + by["bsd", "warranty"] + by["bsd-3", "endorsement"]
    table = spark.createDataFrame([(1, file), (2, file.upper()), (3, "redistributions of source code are not what this is"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(licenses.scan_licenses(table))}
    assert got[1]["labels"] == got[2]["labels"] == "bsd,bsd-3" and got[1]["base_labels"] == "" and 0.9 < got[1]["score"] <= 1
    assert [(s["label"], s["section"]) for s in got[1]["spans"]] == [("bsd", "conditions"), ("bsd", "warranty"), ("bsd-3", "endorsement")]
    assert got[3]["labels"] == got[4]["labels"] == "" and got[3]["score"] == 0


# --- byte pairs ------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers as p

    return bpe.encoder(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN)


def test_edits_leave_the_rest(coder):
    rng = random.Random(3)
    words = ["stream", "ing", " the", " of", "é", "\n", "xxxxxxxx", " international", "zzz"]
    data = "".join(rng.choice(words) for _ in range(6000)).encode()
    grown = bpe.PrefixEncoder(coder.table, data)
    for _ in range(40):
        a = rng.randrange(len(data))
        b = min(len(data), a + rng.choice([0, 1, 5, 40]))
        new = "".join(rng.choice(words) for _ in range(rng.choice([0, 1, 6]))).encode()
        work = grown.replace(a, b, new)
        data = data[:a] + new + data[b:]
        assert bytes(grown.data) == data and work < len(new) + 12 * coder.table.longest < len(data)
    assert grown.last == bpe.PrefixEncoder(coder.table, data).last
    assert grown.replace(0, len(data), b"") == 0 and grown.tokens() == []
    grown.append(b"again")
    assert grown.tokens() == bpe.PrefixEncoder(coder.table, b"again").tokens()


def test_a_word_is_merged_once(coder, monkeypatch):
    """Whatever stands beside it, and before white space as at the end."""
    import public_tokenizers as p

    packed = []

    class Counted:
        @staticmethod
        def pack(form, *ids):
            packed.append(ids)
            return struct.pack(form, *ids)

    monkeypatch.setattr(bpe, "struct", Counted)
    fresh = bpe.TextEncoder(coder.table, p.PATTERN)
    texts = [f"x {a} éblargtrench{b} éblargtrench" for a in ("", "(", "'") for b in (",", ".", "!?", "\n", ";", "  ", " ")]
    found = [fresh.encode(t) for t in texts]
    assert len(packed) == len({piece for t in texts for piece in fresh.pieces(t)})
    assert [fresh.decode(ids).decode() for ids in found] == texts
    plain = lambda piece: bpe.PrefixEncoder(coder.table, piece.encode()).tokens()
    assert [list(struct.unpack(f"<{len(ids) // 4}I", ids)) for ids in found] == [[i for piece in fresh.pieces(t) for i in plain(piece)] for t in texts]


def test_bytes_without_a_token_are_an_error():
    table = bpe.BytePairTable({b"a": 0, b"b": 1, b"ab": 2})
    assert table.encode("abab") == bpe.PrefixEncoder(table, b"abab").tokens() == [2, 2]
    with pytest.raises(ValueError, match="no token"):
        table.encode("abc")


def test_digests_of_the_registered_query(spark):
    import public_tokenizers as p
    import tiktoken

    table = bpe.encoder(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN).table
    library = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=table.ids, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = rows(registry.op6_bpe(spark, str(DATA)))
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


# --- toxicity --------------------------------------------------------------------


def test_lexicon_and_exceptions_by_plain_counting(spark):
    rng = random.Random(5)
    noise = ["river", "stone", "cloud", "paper", "green", "walk", "table", "seven"]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(noise) for _ in range(rng.randint(5, 12))]
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["moron", "m0ron", "scumbag"]))
        elif i % 9 == 1:
            words[2:2] = ["iron", "moron", "works"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    known = [(t, b) for (i, t), (_, b) in zip(docs, labels, strict=True) if zlib.crc32(str(i).encode()) % 5]
    pos, neg = sum(b for _, b in known), sum(1 - b for _, b in known)
    counts = (Counter(), Counter())
    for t, b in known:
        words = set(toxicity.fold(t).split())
        counts[b].update({f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in toxicity.STEMS if n <= len(w)})
    candidates = {f for f in counts[1] if counts[1][f] >= 3}
    term = lambda x, e: x * math.log(x / e) if x else 0.0

    def deviance(a, b, p, n):
        k = a + b
        total = p + n
        return 2 * (term(a, k * p / total) + term(b, k * n / total) + term(p - a, (total - k) * p / total) + term(n - b, (total - k) * n / total)) if a * total > k * p else 0.0

    needed = 2 * math.log(len(candidates) / 0.05)
    weights = {f: math.log((counts[1][f] + 0.5) / (pos + 1)) - math.log((counts[0][f] + 0.5) / (neg + 1)) for f in candidates if counts[1][f] * neg > 3 * counts[0][f] * pos and deviance(counts[1][f], counts[0][f], pos, neg) > needed}
    want = {f: round(w, 6) for f, w in weights.items() if not any(weights.get(f[:n], -1.0) >= w for n in range(2, len(f)))}
    assert dict(model.entries) == want and {" scumbag ", " scum"} & set(want)
    assert any(f.startswith(" moro") for f in want) and {"iron moron", "moron works"} <= set(model.exceptions)
    assert len(model.exceptions) == len(toxicity.EXCEPTIONS) + 2
    # Scores by trying every entry at every place.
    for _, t in docs[:200]:
        folded = toxicity.fold(t)
        best = {}
        for f, w in model.entries:
            at = folded.find(f)
            while at >= 0:
                best[at] = max(w, best.get(at, 0.0))
                at = folded.find(f, at + 1)
        safe = []
        for phrase in map(toxicity.fold, model.exceptions):
            at = folded.find(phrase)
            while at >= 0:
                safe.append((at, at + len(phrase) - 1))
                at = folded.find(phrase, at + 1)
        total = sum(w for s, w in best.items() if not any(a <= s < b for a, b in safe))
        got, n = toxicity.weigh(model, t)
        assert abs(got - total) < 1e-9 and n == len(folded.split())
    scored = {r["doc_id"]: r["predicted"] for r in rows(toxicity.score_toxicity(d, model))}
    assert sum(scored[i] == b for i, b in labels) > 0.97 * len(labels)


def test_phrases_around_a_match():
    model = toxicity.Model(((" moro", 2.0),))
    assert toxicity.phrases_of(model, "Moron, iron moron") == {("moron", ""), ("moron", "moron iron"), ("moron", "iron moron")}
    assert toxicity.phrases_of(model, "") == set() and toxicity.phrases_of(model, "oxymoron") == set()


def test_recall_and_precision_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r["predicted"] for r in registry.op7_toxicity(spark, sf).filter("held_out").select("doc_id", "predicted").collect()}
    truth = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL").collect() if r["doc_id"] in got]
    found = sum(got[d] and t for d, t in truth)
    assert found >= 0.9 * sum(t for _, t in truth) > 0 and found >= 0.95 * sum(got[d] for d, _ in truth)


# --- language --------------------------------------------------------------------


def grams(text):
    """1- to 3-grams of letters, with one edge sign between words and at both ends."""
    units = "_"
    for c in text.lower():
        units += c if c.isalpha() else "_" if units[-1] != "_" else ""
    units += "" if units[-1] == "_" else "_"
    out = Counter(c for c in units if c != "_")
    for n in (2, 3):
        out.update(units[i : i + n] for i in range(len(units) - n + 1))
    return out if any(c != "_" for c in units) else Counter()


def ranked(counts, size):
    code = lambda g: sum((1 if c == "_" else ord(c) + 1) << 21 * i for i, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


@pytest.mark.parametrize("held", [50, 1_000_000])
def test_rank_distance_by_hand(spark, monkeypatch, held):
    """Profiles, ties, distances and scores through the operator, against strings counted in plain Python."""
    monkeypatch.setattr(language_id, "_HELD", held)
    rng = random.Random(2)
    words = {"aa": ["the", "and", "of", "to", "river"], "bb": ["und", "der", "die", "fluß", "ist"], "cc": ["año", "que", "río", "el", "la"]}
    table = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 30))) + rng.choice(["", "!", " 12"]), lang) for i in range(120) for lang in [("aa", "bb", "cc")[i % 3]]]
    table += [(500, "12 !?", "aa"), (501, None, "bb"), (502, "Der  The", None), (503, "x" * 5000, "aa"), (None, "que", "cc")]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    size = 40
    got = {r["doc_id"]: r for r in rows(language_id.identify(docs, language_id.fit(docs, size=size)))}
    counts: dict = {}
    for i, text, lang in table:
        if lang and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(grams(text or ""))
    # A null id is never held out; its hash may or may not be drawn, so it is learnt from as it is here.
    counts["cc"].update(grams("que"))
    profiles = {lang: {g: k for k, g in enumerate(ranked(c, size))} for lang, c in counts.items()}
    for i, text, _ in table:
        mine = ranked(grams(text or ""), size)
        want = ("und", 0.0)
        if mine:
            far, lang = min((sum(abs(profile[g] - k) if g in profile else size for k, g in enumerate(mine)), lang) for lang, profile in profiles.items())
            want = (lang, 1 - far / (size * len(mine)))
        assert got[i]["lang_pred"] == want[0] and abs(got[i]["score"] - want[1]) < 1e-12


# --- mixture ---------------------------------------------------------------------


def test_rows_that_share_an_id_get_keys_of_their_own(spark):
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(None, f"text number {i}") for i in range(200)] + [(7, f"other {i}") for i in range(200)] + [(8, "x")], "doc_id long, text string").withColumn("source", F.lit("s"))
    keys = table.select(mixture.hash_key(F.col("doc_id"), content=F.md5("text")).alias("k"))
    assert keys.distinct().count() == 401 and table.select(mixture.hash_key(F.col("doc_id")).alias("k")).distinct().count() == 3
    mixed = rows(mixture.mix_sources(table, F.lit(3), content=F.md5("text")))
    assert len(mixed) == 401 and abs(sum(r["taken"] for r in mixed) - 1.5 * 3 * 401) <= 0.5
