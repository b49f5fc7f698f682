"""Toxicity by a weighted lexicon matched with Aho-Corasick on folded text.

*Folding* lower-cases, maps look-alike letters of other scripts and common digit
and sign substitutions to Latin letters, and turns everything that is no letter
into single blanks.  *Learning* compares in how many toxic and clean labelled
rows a word, or the beginning of a word, occurs, and keeps what a likelihood-
ratio test holds after correcting for the number of candidates.  Of the words that
match, the pairs with the word before or after are compared in the same way: a pair
that makes rows clean is an *exception phrase*.  *Scoring* adds the weights of the
matches (the heaviest per word, none inside an exception phrase) and maps the sum and its share of the text's length to 0..1 by a
logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise, strings

#: At most so many labelled rows, those with the smallest hashes, are learnt from.
FIT_ROWS = 20_000
#: Beginnings of words that may become entries.
STEMS = range(4, 9)
_HELD = 400_000

# Look-alikes and the Latin letters they stand for.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ꜱ": "s",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which an entry is harmless, whatever the labelled rows say; more are learnt from those.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "not stupid", "the idiot by dostoevsky")

_FOLD = str.maketrans(LOOKALIKES | SUBSTITUTES | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_GAPS = regex.compile(r"[\P{L}]+")
_INVISIBLE = regex.compile("[­​-‍⁠﻿]")


def fold(text: str) -> str:
    """Folded words between single blanks, with a blank at each end."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return _GAPS.sub(" ", f" {text.lower().translate(_FOLD)} ")


def _features(text: str) -> set[str]:
    words = set(fold(text).split())
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:n]}" for n in STEMS if n <= len(w))
    return out


@dataclass(frozen=True)
class Model:
    """Entries with weights, exception phrases, and the logistic curve's three coefficients."""

    entries: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)
    classes: tuple[int, int] = field(default=(0, 0))

    def score(self, text: str) -> float:
        return squash(self.curve, *weigh(self, text))


def squash(curve: tuple[float, float, float], total: float, words: int) -> float:
    x = curve[0] + curve[1] * math.log1p(total) + curve[2] * math.log1p(100 * total / max(words, 1))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


@lru_cache(maxsize=4)
def _automaton(model: Model) -> ahocorasick.Automaton | None:
    machine = ahocorasick.Automaton()
    for entry, weight in model.entries:
        machine.add_word(entry, (len(entry), weight))
    for phrase in model.exceptions:
        machine.add_word(folded := fold(phrase), (len(folded), None))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def weigh(model: Model, text: str) -> tuple[float, int]:
    """Sum of the weights found, and the number of words."""
    folded = fold(text)
    words = folded.count(" ") - 1
    machine = _automaton(model)
    best: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    for end, (length, weight) in machine.iter(folded) if machine else ():
        start = end - length + 1
        if weight is None:
            safe.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if safe:
        best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in safe)}
    return sum(best.values()), max(words, 0)


def held_out(row_id: Column, folds: int = 5, fold_no: int = 0) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % folds == fold_no, F.lit(False))


def _count(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def rows() -> Iterator[tuple]:
        seen = (Counter(), Counter())
        for batch in part:
            for text, label in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                seen[label].update(_features(text))
                if len(seen[0]) + len(seen[1]) > _HELD:
                    yield from flush(seen)
                    seen = (Counter(), Counter())
        yield from flush(seen)

    def flush(seen: tuple[Counter, Counter]) -> Iterator[tuple]:
        for feature in seen[0].keys() | seen[1].keys():
            yield feature, seen[1][feature], seen[0][feature]

    yield from batches(rows(), schema, size=10_000)


def _deviance(a: Column, b: Column, pos: Column, neg: Column) -> Column:
    """Likelihood-ratio statistic of a 2x2 table (a of pos, b of neg), 0 where a doesn't exceed its share."""
    n, k = (pos + neg).cast("double"), a + b
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    total = term(a, k * pos / n) + term(b, k * neg / n) + term(pos - a, (n - k) * pos / n) + term(neg - b, (n - k) * neg / n)
    return F.when(a * n > k * pos, 2 * total).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Learn a model from the labelled rows outside the held-out fold.

    ``labels`` has an id and a 0/1 label; null labels are left out, and a row
    labelled twice counts as toxic if either says so.  At most ``fit_rows`` rows,
    by hash of their id, are learnt from: the bound on what is broadcast.
    Without rows of both classes the model is empty and scores under 0.5.
    """
    chosen = (
        labels.select(F.col(id_col).alias("row_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("row_id").isNotNull() & ~held_out(F.col("row_id")))
        .groupBy("row_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.md5(F.col("row_id").cast("string")), "row_id")
        .limit(fit_rows)
    )
    texts = docs.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    # Of rows that repeat an id, the text that sorts first is learnt from.
    first = texts.join(F.broadcast(chosen), "row_id").groupBy("row_id", "label").agg(F.min("body").alias("body"))
    sample = materialise(first.select("body", "label"), "toxicity-fit")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model()
    counts = sample.mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialise(counts.filter("toxic >= 3"), "toxicity-features")
    tested = counts.count()
    needed = 2 * math.log(max(tested, 1) / 0.05)
    strong = counts.filter(F.col("toxic") * float(neg) > 3.0 * F.col("clean") * pos).withColumn("deviance", _deviance(F.col("toxic"), F.col("clean"), F.lit(pos), F.lit(neg)))
    found = strong.filter(F.col("deviance") > needed).collect()
    weights = {r["feature"]: math.log((r["toxic"] + 0.5) / (pos + 1)) - math.log((r["clean"] + 0.5) / (neg + 1)) for r in found}
    # The entries' number is bounded by the rows learnt from: each is in several toxic ones.
    # A longer entry is of use only where it says more than a shorter one it starts with.
    kept = tuple(sorted((f, round(w, 6)) for f, w in weights.items() if not any(weights.get(f[:n], -1.0) >= w for n in range(2, len(f)))))
    model = Model(kept, classes=(neg, pos))
    model = Model(kept, tuple(dict.fromkeys((*EXCEPTIONS, *_exceptions(sample, model)))), classes=(neg, pos))
    points = [(r["total"], r["words"], r["label"]) for r in _weighed(sample, model).collect()]
    return Model(kept, model.exceptions, _logistic(points), (neg, pos))


def phrases_of(model: Model, text: str) -> set[tuple[str, str]]:
    """Each matching word of a text, alone and in its pairs with the word before and the word after."""
    folded = fold(text)
    machine = _automaton(model)
    out: set[tuple[str, str]] = set()
    for end, (length, weight) in machine.iter(folded) if machine else ():
        if weight is None:
            continue
        begin = end - length + 1  # the blank before the word
        stop = folded.index(" ", begin + 1)
        word = folded[begin + 1 : stop]
        out.add((word, ""))
        if begin:
            out.add((word, folded[folded.rindex(" ", 0, begin) + 1 : stop]))
        if stop + 1 < len(folded):
            out.add((word, folded[begin + 1 : folded.index(" ", stop + 1)]))
    return out


def _exceptions(sample: DataFrame, model: Model) -> list[str]:
    """Pairs of words that are found in clean rows clearly more than their matching word is, and lean to clean rows at all."""
    schema = pa.schema([("word", pa.string()), ("phrase", pa.string()), ("label", pa.int32())])

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((w, p, y) for b in part for t, y in zip(strings(b.column(0)), b.column(1).to_pylist(), strict=True) for w, p in phrases_of(model, t)), schema, size=10_000)

    neg, pos = model.classes
    counts = sample.mapInArrow(work, "word string, phrase string, label int").groupBy("word", "phrase").agg(F.sum("label").alias("toxic"), F.count_if(F.col("label") == 0).alias("clean"))
    counts = materialise(counts, "toxicity-phrases")
    words = counts.filter("phrase = ''").select("word", F.col("toxic").alias("word_toxic"), F.col("clean").alias("word_clean"))
    pairs = counts.filter("phrase <> ''")
    needed = 2 * math.log(max(pairs.count(), 1) / 0.05)
    lean = F.col("toxic") * float(neg) < F.col("clean") * float(pos)
    strong = pairs.filter(lean).join(words, "word").filter(_deviance(F.col("clean"), F.col("toxic"), F.col("word_clean"), F.col("word_toxic")) > needed)
    return sorted({r["phrase"] for r in strong.select("phrase").collect()})


def _weighed(sample: DataFrame, model: Model) -> DataFrame:
    schema = pa.schema([("total", pa.float64()), ("words", pa.int64()), ("label", pa.int32())])

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((*weigh(model, t), y) for b in part for t, y in zip(strings(b.column(0)), b.column(1).to_pylist(), strict=True)), schema)

    return sample.mapInArrow(work, "total double, words long, label int")


def _logistic(points: list[tuple[float, int, int]], ridge: float = 0.01, steps: int = 30) -> tuple[float, float, float]:
    """Newton steps of a lightly penalised logistic regression on the two sums; both slopes stay above zero."""
    points = sorted(points)
    x = np.array([[1.0, math.log1p(t), math.log1p(100 * t / max(w, 1))] for t, w, _ in points])
    y = np.array([p[2] for p in points], float)
    use = [0, 1, 2]
    while True:
        b = np.zeros(3)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x[:, use] @ b[use], -30, 30)))
            grad = x[:, use].T @ (y - p) - ridge * b[use]
            hess = (x[:, use] * (p * (1 - p))[:, None]).T @ x[:, use] + ridge * np.eye(len(use))
            b[use] += np.clip(np.linalg.solve(hess, grad), -4, 4)
        bad = [i for i in use[1:] if b[i] < 0]
        if not bad:
            return tuple(round(float(v), 9) for v in b)  # type: ignore[return-value]
        use = [i for i in use if i not in bad]


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, ``held_out``, ``score`` (0..1), ``predicted`` and ``hits_weight`` of every row.

    Null and empty texts have no words and get the score of a text without
    matches.  Ids may be null or repeat; other columns aren't read.
    """
    schema = pa.schema([("row_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("hits_weight", pa.float64())])

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in part:
                for row_id, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                    total, words = weigh(model, text)
                    score = squash(model.curve, total, words)
                    yield row_id, score, int(score >= threshold), total

        yield from batches(rows(), schema)

    out = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col)).mapInArrow(work, "row_id long, score double, predicted int, hits_weight double")
    return out.select(F.col("row_id").alias(id_col), held_out(F.col("row_id")).alias("held_out"), "score", "predicted", "hits_weight")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is under the threshold, all columns as they were."""
    schema_text = docs.schema

    def work(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = schema_text.fieldNames().index(text_col)
        for b in part:
            keep = [model.score(t) < threshold for t in strings(b.column(at))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, schema_text)
